"""Clone calling from rare features and joint alleles, and composition of units by clone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.scalars import joint_alleles, locus
from cellweft.operators.graph import component_sizes, weak_components
from cellweft.operators.lineage import LOCI
from cellweft.operators.pairs import basket_pairs
from cellweft.operators.quantiles import quantiles
from cellweft.session import cut


# --- signatures ------------------------------------------------------------------------------------------------------

def feature_reference(evidence: DataFrame, rare: float = 0.001, low: float = 0.005) -> DataFrame:
    """(feature, n_cells, total, fraction, rarity, frequency_class, valid) over cells with evidence.

    rarity = -ln(fraction + 1 / (10 N)); a feature is rare, low or common_filtered by its share of the N cells.
    """
    n = evidence.agg(F.countDistinct("cell_key").alias("_n"))
    f = evidence.groupBy("feature").agg(F.countDistinct("cell_key").alias("n_cells"), F.sum("n").alias("total")).crossJoin(F.broadcast(n))  # one row
    share = F.col("n_cells") / F.col("_n")
    cls = F.when(share <= rare, "rare").when(share <= low, "low").otherwise("common_filtered")
    return f.select("feature", "n_cells", "total", share.alias("fraction"), (-F.ln(share + 1 / (10 * F.col("_n")))).alias("rarity"), cls.alias("frequency_class"), (share <= low).alias("valid"))


def cell_complexity(evidence: DataFrame, q: float = 0.99) -> DataFrame:
    """(cell_key, n_features, n_loci, max_fraction, bridge_score, bridge): score n * max(loci, 1) * (1 - largest share); bridge above the quantile."""
    c = evidence.groupBy("cell_key").agg(F.countDistinct("feature").alias("n_features"), F.countDistinct("assay").alias("n_loci"), (F.max("n") / F.sum("n")).alias("max_fraction"))
    c = c.withColumn("bridge_score", F.col("n_features") * F.greatest("n_loci", F.lit(1)) * (1 - F.col("max_fraction")))
    lim = quantiles(c, [], "bridge_score", _q=q)
    return c.crossJoin(F.broadcast(lim)).withColumn("bridge", (F.col("bridge_score") > F.col("_q")) & (F.col("n_features") > 1)).drop("_q")  # one row


def compatibility_graph(evidence: DataFrame, least: int = 2) -> DataFrame:
    """(src, dst, observed, jaccard): features together in at least ``least`` cells (K4). ``evidence``: cell_key, feature.

    Cells are paired in blocks of their features. Features in fewer cells than ``least`` cannot be in a pair and are dropped first.
    """
    e = evidence.select("cell_key", "feature").where("cell_key IS NOT NULL AND feature IS NOT NULL").distinct()
    n = e.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = e.join(n.select("feature"), "feature", "left_semi")
    p = basket_pairs(kept.select(F.col("cell_key").alias("basket"), F.col("feature").alias("item"))).where(F.col("n") >= least).toDF("src", "dst", "observed")
    p = p.join(n.toDF("src", "na"), "src").join(n.toDF("dst", "nb"), "dst")
    return p.select("src", "dst", "observed", (F.col("observed") / (F.col("na") + F.col("nb") - F.col("observed"))).alias("jaccard"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, n, rank): components by size, ties by smallest member (K5)."""
    c = weak_components(nodes, edges)
    return c.join(component_sizes(c), "component").select("id", "component", "n", "rank")


def signatures(evidence: DataFrame, members: DataFrame, most: int = 100) -> DataFrame:
    """(signature, n_features, n_loci, n_cells, clone_class): components as signatures.

    ``members``: feature, signature. Class A has features of at least two loci, B several of one, C a single one; more than ``most``
    features are ``filtered``.
    """
    e = evidence.join(members, "feature")
    s = e.groupBy("signature").agg(F.countDistinct("feature").alias("n_features"), F.countDistinct("assay").alias("n_loci"), F.countDistinct("cell_key").alias("n_cells"))
    cls = F.when(F.col("n_features") > most, "filtered").when(F.col("n_loci") >= 2, "A").when(F.col("n_features") > 1, "B").otherwise("C")
    return s.withColumn("clone_class", cls)


def candidate_scores(evidence: DataFrame, members: DataFrame, reference: DataFrame) -> DataFrame:
    """(cell_key, signature, score): sum of rarity * ln(1 + n) + 0.75 per locus + share of the signature's features seen (K7)."""
    size = members.groupBy("signature").agg(F.countDistinct("feature").alias("size"))
    e = evidence.groupBy("cell_key", "feature", "assay").agg(F.sum("n").alias("n")).join(members, "feature").join(reference.select("feature", "rarity"), "feature")
    s = e.groupBy("cell_key", "signature").agg(F.sum(F.col("rarity") * F.log1p(F.col("n").cast("double"))).alias("base"), F.countDistinct("assay").alias("loci"), F.countDistinct("feature").alias("seen")).join(size, "signature")
    return s.select("cell_key", "signature", (F.col("base") + 0.75 * F.col("loci") + F.col("seen") / F.col("size")).alias("score"))


def decided(scores: DataFrame, least: float, margin: float, multi: float = 0.75, keep: int = 5) -> DataFrame:
    """(cell_key, best, score, second, margin, n_candidates, status): assigned_single, assigned_multi, ambiguous or unassigned.

    Multi: the second score reaches ``least`` and ``multi`` of the best. Ambiguous: the lead is under ``margin``. Ties by signature.
    """
    w = Window.partitionBy("cell_key").orderBy(F.desc("score"), "signature")
    k = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    a = k.groupBy("cell_key").agg(F.max(F.when(F.col("r") == 1, F.col("signature"))).alias("best"), F.max("score").alias("score"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"), F.count("*").alias("n_candidates"))
    lead = F.col("score") - F.coalesce("second", F.lit(0.0))
    status = F.when(F.col("score") < least, "unassigned").when((F.col("second") >= least) & (F.col("second") >= multi * F.col("score")), "assigned_multi").when(lead < margin, "ambiguous").otherwise("assigned_single")
    return a.select("cell_key", "best", "score", "second", lead.alias("margin"), "n_candidates", status.alias("status"))


def memberships(scores: DataFrame, supported: float = 0.75) -> DataFrame:
    """(cell_key, signature, weight, z, primary, ambiguous): score shares per cell."""
    w = Window.partitionBy("cell_key")
    total, n = F.sum("score").over(w), F.count(F.lit(1)).over(w)
    stats = scores.agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    s = scores.crossJoin(F.broadcast(stats)).withColumn("weight", F.col("score") / total).withColumn("_n", n)  # one row
    top = F.row_number().over(w.orderBy(F.desc("score"), "signature")) == 1
    return s.select("cell_key", "signature", "weight", F.coalesce((F.col("score") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0)).alias("z"), top.alias("primary"), ((F.col("_n") > 1) & (F.max("weight").over(w) < supported)).alias("ambiguous"))


def null_thresholds(scores: DataFrame, null_scores: DataFrame, q_score: float = 0.99, q_margin: float = 0.95) -> DataFrame:
    """One row (min_score, min_margin): quantiles of best score and lead under shuffled features (K9)."""
    def best(s: DataFrame) -> DataFrame:
        r = s.withColumn("r", F.row_number().over(Window.partitionBy("cell_key").orderBy(F.desc("score"), "signature"))).where("r <= 2")
        return r.groupBy("cell_key").agg(F.max("score").alias("b"), (F.max("score") - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0))).alias("m"))

    real, shuffled = quantiles(best(scores), [], "b", fb=0.05), best(null_scores)
    null = quantiles(shuffled, [], "b", nb=q_score).crossJoin(quantiles(shuffled, [], "m", nm=q_margin))
    return null.crossJoin(real).select(F.coalesce("nb", "fb").alias("min_score"), F.coalesce("nm", 0.1 * F.col("fb")).alias("min_margin"))  # one row each


def sensitivity(reference: DataFrame, fractions: Sequence[float], least_cells: Sequence[int]) -> DataFrame:
    """(max_fraction, min_cells, n_valid, n_filtered) over a grid of thresholds, in one pass over the features."""
    grid = F.array(*[F.struct(F.lit(float(a)).alias("max_fraction"), F.lit(int(b)).alias("min_cells")) for a in fractions for b in least_cells])
    g = reference.select("n_cells", "fraction", F.explode(grid).alias("g")).select("n_cells", "fraction", "g.*")
    ok = (F.col("fraction") <= F.col("max_fraction")) & (F.col("n_cells") >= F.col("min_cells"))
    return g.groupBy("max_fraction", "min_cells").agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_filtered"))


def allele_metadata(annotation: DataFrame, feature: str, allele: str, most: int = 3) -> DataFrame:
    """(feature, alleles, n_alleles, all_missing): up to ``most`` sorted distinct alleles joined by ``;`` (K1).

    Alleles are ranked and limited before they are collected, so a feature with very many keeps a bounded list.
    """
    d = annotation.select(feature, F.nullif(F.trim(allele), F.lit("")).alias("a")).distinct()
    r = d.withColumn("r", F.row_number().over(Window.partitionBy(feature).orderBy(F.col("a").asc_nulls_last())))
    return r.groupBy(feature).agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("r") <= most, F.col("a")))), ";").alias("alleles"), F.count("a").alias("n_alleles"), F.bool_and(F.col("a").isNull()).alias("all_missing"))


# --- joint clones ----------------------------------------------------------------------------------------------------

def one_allele_per_locus(df: DataFrame) -> DataFrame:
    """(cell_key, locus, allele, count, candidates): most counted allele of each locus, ties by allele (J5). ``df``: cell_key, allele, n."""
    a = df.withColumn("locus", locus("allele")).where("locus IS NOT NULL").groupBy("cell_key", "locus", "allele").agg(F.sum("n").alias("count"))
    w = Window.partitionBy("cell_key", "locus")
    return a.withColumn("candidates", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("count"), "allele"))).where("r = 1").drop("r")


def joint_ids(per_locus: DataFrame, loci: Sequence[str] = LOCI) -> DataFrame:
    """(cell_key, joint_id): alleles by locus order joined by ``@``, a missing one as ``nan``."""
    return per_locus.groupBy("cell_key").agg(F.concat_ws("@", *[F.coalesce(F.max(F.when(F.col("locus") == x, F.col("allele"))), F.lit("nan")) for x in loci]).alias("joint_id"))


def allele_frequencies(joint: DataFrame, col: str = "joint_clone_id") -> DataFrame:
    """(allele, locus, n_cells, fraction) over the alleles of joint ids."""
    n = joint.where(F.size(joint_alleles(col)) > 0).agg(F.count("*").alias("_n"))
    a = joint.select(F.explode(joint_alleles(col)).alias("allele")).groupBy("allele").agg(F.count("*").alias("n_cells"))
    return a.crossJoin(F.broadcast(n)).select("allele", locus("allele").alias("locus"), "n_cells", (F.col("n_cells") / F.col("_n")).alias("fraction"))  # one row


def merged_joint_ids(joint: DataFrame, col: str = "joint_clone_id", most: int = 6) -> DataFrame:
    """(joint_id, component): joint ids that share an allele of few ids and disagree at no shared locus are one clone.

    Distinct ids only, so a clone of very many cells is one row. An allele of ``most`` or more ids links nothing.
    """
    ids = joint.where(F.size(joint_alleles(col)) > 0).select(F.col(col).alias("id")).distinct().withColumn("a", joint_alleles("id"))
    x = ids.select("id", "a", F.explode("a").alias("allele"))
    few = x.groupBy("allele").agg(F.count("*").alias("k")).where((F.col("k") >= 2) & (F.col("k") < most))
    x = x.join(few, "allele")
    p = x.select("allele", F.col("id").alias("src"), F.col("a").alias("sa")).join(x.select("allele", F.col("id").alias("dst"), F.col("a").alias("da")), "allele").where("src < dst")
    clash = F.exists("sa", lambda u: F.exists("da", lambda v: (F.substring_index(u, "_", 1) == F.substring_index(v, "_", 1)) & (u != v)))
    e = p.where(~clash).select("src", "dst").distinct()
    return weak_components(ids.select("id"), e).select(F.col("id").alias("joint_id"), "component")


def allele_classes(frequencies: DataFrame, known: DataFrame, rare: float = 0.001, de_novo: str = "empirical", low: float = 0.005) -> DataFrame:
    """Adds allele_class and valid (J4). ``frequencies``: allele, locus, n_cells, fraction; ``known``: allele, normalized_count, distinct.

    An allele without a locus is a mismatch; a known one is rare under ``rare``, else common; an unknown one is de novo, valid if ``de_novo``
    is ``all``, or ``empirical`` and its fraction is under ``low``; not with ``none``.
    """
    j = frequencies.join(known.select("allele", F.col("normalized_count").alias("_k"), F.lit(True).alias("_known")), "allele", "left")
    cls = F.when(F.col("locus").isNull(), "locus_mismatch").when(F.col("_known") & (F.col("_k") < rare), "reference_mapped_rare").when(F.col("_known"), "reference_mapped_common").otherwise("unmapped_de_novo_candidate")
    fresh = {"all": F.lit(True), "empirical": F.col("fraction") < low, "none": F.lit(False)}[de_novo]
    j = j.withColumn("allele_class", cls)
    return j.withColumn("valid", (F.col("allele_class") == "reference_mapped_rare") | ((F.col("allele_class") == "unmapped_de_novo_candidate") & fresh)).drop("_k", "_known")


def joint_clones(alleles: DataFrame, prob_cutoff: float = 0.1, sample_cutoff: float = 2, most: int = 6, loci: Sequence[str] = LOCI) -> tuple[DataFrame, DataFrame]:
    """(cells: cell_key, tmp_id, joint_clone_id, joint_prob, joint_allele_num, bc_consistency), (clones: joint_clone_id, bc_num, ...).

    ``alleles``: cell_key, locus, allele, normalized_count, sample_count; several of a cell and locus: the smallest by text counts. Alleles at or over
    a cutoff are left out. A cell's tmp id joins its alleles by locus, a missing one as ``nan``. An allele of ``most`` or more tmp ids
    is promoted to the cutoff. Tmp ids that share an allele under the cutoff, of 2 to ``most`` - 1 ids, and disagree at no locus
    that both have are one clone; its id joins its distinct alleles by locus, in the order of the first cell that has them.
    joint_prob multiplies the alleles' least counts, promoted ones at the cutoff. bc_consistency is the share of pairs of the clone's tmp
    ids that do not disagree, counted from compact counts of their alleles, never pair by pair.
    """
    kept = alleles.where((F.col("normalized_count") < prob_cutoff) & (F.col("sample_count") < sample_cutoff) & F.col("locus").isin(*loci))
    one = kept.groupBy("cell_key", "locus").agg(F.min("allele").alias("allele"))
    wide = cut(one.groupBy("cell_key").agg(*[F.max(F.when(F.col("locus") == x, F.col("allele"))).alias(x) for x in loci])
               .withColumn("tmp_id", F.concat_ws("@", *[F.coalesce(x, F.lit("nan")) for x in loci])))
    ids = wide.groupBy("tmp_id", *loci).agg(F.min("cell_key").alias("first"))
    cells_of = one.join(kept, ["cell_key", "locus", "allele"]).groupBy("allele").agg(F.min("normalized_count").alias("least"))
    long = ids.select("tmp_id", "first", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(x).alias("allele")) for i, x in enumerate(loci)])).alias("e")).select("tmp_id", "first", "e.*").where("allele IS NOT NULL")
    norm = cut(long.groupBy("allele").agg(F.count("*").alias("k")).join(cells_of, "allele").withColumn("prob", F.when((F.col("k") >= most) & (F.col("least") < prob_cutoff), prob_cutoff).otherwise(F.col("least"))))
    # Under ``most`` ids an allele, so pairs of one allele are few.
    few = long.join(norm.where((F.col("prob") < prob_cutoff) & (F.col("k") >= 2) & (F.col("k") < most)).select("allele"), "allele").select("allele", "tmp_id").join(ids, "tmp_id")
    a, b = few.select("allele", F.col("tmp_id").alias("src"), *[F.col(x).alias(f"a_{x}") for x in loci]), few.select("allele", F.col("tmp_id").alias("dst"), *[F.col(x).alias(f"b_{x}") for x in loci])
    agree = F.lit(True)
    for x in loci:
        agree = agree & F.coalesce(F.col(f"a_{x}") == F.col(f"b_{x}"), F.lit(True))
    edges = a.join(b, "allele").where("src < dst").where(agree).select("src", "dst").distinct()
    comp = cut(weak_components(ids.select(F.col("tmp_id").alias("id")), edges).withColumnRenamed("id", "tmp_id"))
    named = long.join(comp, "tmp_id").groupBy("component", "at", "allele").agg(F.min("first").alias("first"))
    names = named.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("at", "first", "allele"))).alias("l"))
    names = names.select("component", F.array_join(F.transform("l", lambda x: x["allele"]), "@").alias("joint_clone_id"), F.size("l").alias("joint_allele_num"))
    # Pairs that agree: by the loci both have, tmp ids with the same alleles there.
    n = len(loci)
    mask = sum((F.col(x).isNull().cast("int") * (1 << i) for i, x in enumerate(loci)), F.lit(0))
    sets = [F.struct(F.lit(m).alias("both"), F.concat_ws("|", *[F.coalesce(F.col(x), F.lit("")) for i, x in enumerate(loci) if m >> i & 1]).alias("values")) for m in range(1 << n)]
    held = ids.join(comp, "tmp_id").select("component", mask.alias("gone"), F.explode(F.array(*sets)).alias("s")).select("component", "gone", "s.*").where(F.col("gone").bitwiseAND(F.col("both")) == 0)
    c = held.groupBy("component", "both", "values", "gone").agg(F.count("*").alias("c"))
    two = c.join(c.select("component", "both", "values", F.col("gone").alias("gone2"), F.col("c").alias("c2")), ["component", "both", "values"])
    exact = two.where(F.col("both") == F.lit((1 << n) - 1).bitwiseXOR(F.col("gone").bitwiseOR(F.col("gone2"))))
    same = exact.groupBy("component").agg(F.sum(F.col("c") * F.col("c2")).alias("ordered"))
    size = comp.groupBy("component").agg(F.count("*").alias("bc_num"))
    pairs = F.col("bc_num") * (F.col("bc_num") - 1) / 2
    clones = size.join(names, "component").join(same, "component").select(
        "component", "joint_clone_id", "bc_num", "joint_allele_num", F.when(F.col("bc_num") <= 1, 1.0).otherwise((F.col("ordered") - F.col("bc_num")) / 2 / pairs).alias("bc_consistency"))
    clones = cut(clones)
    prob = F.lit(1.0)
    cells = wide
    for x in loci:
        cells = cells.join(norm.select(F.col("allele").alias(x), F.col("prob").alias(f"p_{x}")), x, "left")
        prob = prob * F.coalesce(F.col(f"p_{x}"), F.lit(1.0))
    cells = cells.join(comp, "tmp_id").join(clones, "component").select("cell_key", "tmp_id", "joint_clone_id", prob.alias("joint_prob"), "joint_allele_num", "bc_consistency")
    return cells, clones.drop("component")


def clone_qc(assigned: DataFrame, giant: float = 0.05, one_section: float = 0.95, large: int = 100) -> DataFrame:
    """One row per joint clone: cells, share, sections, largest section share, loci, flags and status.

    ``assigned``: cell_key, slice_id, joint_clone_id, joint_prob; one row a cell. Giant clones are filtered; those almost wholly in one
    section, or of a single locus, are warned of.
    """
    a = assigned.where(F.size(joint_alleles("joint_clone_id")) > 0)
    per = a.groupBy("joint_clone_id", "slice_id").agg(F.count("*").alias("n"), F.sum("joint_prob").alias("sp"), F.count("joint_prob").alias("np"))
    total = per.agg(F.sum("n").alias("_n"))
    c = per.groupBy("joint_clone_id").agg(F.sum("n").alias("n_cells"), F.count("*").alias("n_sections"), F.max("n").alias("_m"), (F.sum("sp") / F.nullif(F.sum("np"), F.lit(0))).alias("mean_prob")).crossJoin(F.broadcast(total))  # one row
    al = joint_alleles("joint_clone_id")
    c = c.select("joint_clone_id", "n_cells", (F.col("n_cells") / F.col("_n")).alias("clone_share"), "n_sections", (F.col("_m") / F.col("n_cells")).alias("section_share"), F.size(F.array_distinct(F.transform(al, lambda x: F.substring_index(x, "_", 1)))).alias("n_loci"), "mean_prob")
    flags = F.concat_ws(";", F.when(F.col("clone_share") >= giant, "giant_clone"), F.when((F.col("section_share") >= one_section) & (F.col("n_cells") >= large), "single_section"), F.when(F.col("n_loci") == 1, "single_locus"))
    c = c.withColumn("flags", flags)
    return c.withColumn("status", F.when(F.contains("flags", F.lit("giant_clone")), "filtered").when(F.col("flags") != "", "warning").otherwise("pass"))


def policy_selection(scores: DataFrame, terms: dict[str, float], name: str) -> DataFrame:
    """Policies by weighted score of their metrics, best first, ties by name, with ``selected``."""
    s = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in terms.items()), F.lit(0.0))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), name)  # a row a policy
    return scores.withColumn("score", s).withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") == 1)


def unit_composition(units: DataFrame, assigned: DataFrame, unit: str = "unit", clone: str = "clone_id") -> DataFrame:
    """One row per unit: cells, cells with a clone, coverage, richness, dominant clone and share, entropy, Simpson, clones text.

    ``units``: unit, cell_key (a cell may be in several). Units without clones stay, at 0.
    """
    from cellweft.operators.diversity import diversity

    m = units.select(unit, "cell_key").distinct().join(assigned.select("cell_key", clone), "cell_key", "left")
    n = m.groupBy(unit).agg(F.count("*").alias("n_cells"), F.count(clone).alias("n_assigned"))
    c = m.where(F.col(clone).isNotNull()).groupBy(unit, clone).agg(F.count("*").alias("n"))
    d = diversity(c, [unit], clone).drop("total")
    out = n.join(d, unit, "left").na.fill(0, ["richness", "dominant_share", "entropy", "norm_entropy", "simpson"])
    return out.withColumn("coverage", F.col("n_assigned") / F.col("n_cells"))


def layers(named: dict[str, DataFrame], total: int | None = None) -> DataFrame:
    """(layer, n_cells, n_assigned, fraction): one row per calling layer (J12, N7). Each frame: cell_key, clone."""
    from functools import reduce

    rows = [d.agg(F.count("*").alias("n_cells"), F.count("clone").alias("n_assigned")).select(F.lit(k).alias("layer"), "n_cells", "n_assigned") for k, d in named.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("fraction", F.col("n_assigned") / F.nullif(F.col("n_cells"), F.lit(0)))


def loss_audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(status_a, status_b, n): cells by what two callings made of them, absent ones ``none`` (K13). Inputs: cell_key, status."""
    j = a.select("cell_key", F.col("status").alias("sa")).join(b.select("cell_key", F.col("status").alias("sb")), "cell_key", "full")
    return j.groupBy(F.coalesce("sa", F.lit("none")).alias("status_a"), F.coalesce("sb", F.lit("none")).alias("status_b")).agg(F.count("*").alias("n"))


def class_floor(c: Column, by_class: Column, floors: dict[str, float]) -> Column:
    """``c`` raised to the floor of its class."""
    f = F.lit(0.0)
    for k, v in floors.items():
        f = F.when(by_class == k, v).otherwise(f)
    return F.greatest(c, f)


def membership_thresholds(null: DataFrame, group: str, score: str, floors: dict[str, float], by_class: str) -> DataFrame:
    """(group, class, q95, q99, mu, sigma, threshold): a normal null fitted to the 95 and 99 % quantiles of null scores, raised to class floors.

    The threshold is the fitted 99 % point: mu + 2.326 sigma, with sigma = (q99 - q95) / (2.326 - 1.645).
    """
    q = quantiles(null, [group, by_class], score, q95=0.95, q99=0.99)
    sigma = (F.col("q99") - F.col("q95")) / (2.326 - 1.645)
    q = q.withColumn("sigma", sigma).withColumn("mu", F.col("q95") - 1.645 * F.col("sigma"))
    return q.withColumn("threshold", class_floor(F.col("mu") + 2.326 * F.col("sigma"), F.col(by_class), floors))


def loss_reasons(scores: DataFrame, decided_: DataFrame, signature: str = "signature") -> DataFrame:
    """Per signature: cells that overlap it, cells assigned to it, lost to a better one, under the threshold, ambiguous, and the conversion rate."""
    j = scores.select("cell_key", signature).distinct().join(decided_.select("cell_key", "best", "status"), "cell_key", "left")
    mine = F.col("best") == F.col(signature)
    hit = F.coalesce(mine & F.col("status").startswith("assigned"), F.lit(False))
    g = j.groupBy(signature).agg(
        F.count("*").alias("overlap"), F.count_if(hit).alias("assigned"), F.count_if(~F.coalesce(mine, F.lit(False))).alias("better_elsewhere"),
        F.count_if(mine & (F.col("status") == "unassigned")).alias("under_threshold"), F.count_if(mine & (F.col("status") == "ambiguous")).alias("ambiguous"))
    return g.withColumn("conversion", F.col("assigned") / F.col("overlap"))
