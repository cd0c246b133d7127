"""Row-level expressions: identifiers, alleles, guarded arithmetic, distances between vectors and between label distributions.

Missing labels are null, never the text ``nan``, except where a format says so (joint clone ids).
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- names -----------------------------------------------------------------------------------------------------------

def token(c: Column | str) -> Column:
    """Lower-case name of letters, digits and single underscores; ``na`` if nothing is left (F2)."""
    return F.coalesce(F.nullif(F.lower(F.trim(F.regexp_replace(_c(c), "[^0-9A-Za-z]+", "_"), F.lit("_"))), F.lit("")), F.lit("na"))


def file_name(c: Column | str) -> Column:
    """Text fit for a file name: letters, digits, dot, underscore and hyphen stay, others become an underscore."""
    return F.regexp_replace(_c(c), "[^0-9A-Za-z._-]", "_")


def split_feature(c: Column | str) -> Column:
    """(assay, feature) of ``assay::feature``, split once."""
    parts = F.split(_c(c), "::", 2)
    return F.struct(parts[0].alias("assay"), F.get(parts, 1).alias("feature"))


def anchor_id(slice_: Column | str, index: Column | str) -> Column:
    """``slice::index``."""
    return F.concat(_c(slice_), F.lit("::"), _c(index).cast("string"))


def day_of_label(c: Column | str) -> Column:
    """Day number of a label such as ``D21``, null if it has none."""
    return F.regexp_extract(_c(c), r"D(\d+)", 1).try_cast("int") if hasattr(Column, "try_cast") else F.nullif(F.regexp_extract(_c(c), r"D(\d+)", 1), F.lit("")).cast("int")


def expand_range(spec: str) -> list[str]:
    """``name001..name050`` as its 50 names with the padding kept (F6). Prefixes must agree and the range must ascend."""
    m = re.fullmatch(r"(.*?)(\d+)\.\.(.*?)(\d+)", spec)
    if not m:
        return [spec]
    (p, a, q, b) = m.groups()
    if p != q or int(a) > int(b):
        raise ValueError(f"not an ascending range of one prefix: {spec}")
    return [f"{p}{i:0{len(a)}d}" for i in range(int(a), int(b) + 1)]


def select_columns(columns: Sequence[str], specs: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Columns named by explicit names, ranges and glob patterns, in first-named order without repeats.

    ``include`` keeps names with any of these parts, ``exclude`` drops those with any. An explicit name that is absent is an error.
    """
    out: dict[str, None] = {}
    for spec in specs:
        if any(x in spec for x in "*?["):
            out.update(dict.fromkeys(c for c in columns if fnmatch.fnmatchcase(c, spec)))
            continue
        for name in expand_range(spec):
            if name not in columns:
                raise ValueError(f"no column {name}")
            out[name] = None
    return [c for c in out if (not include or any(i in c for i in include)) and not any(e in c for e in exclude)]


def column_groups(columns: Sequence[str], rules: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Columns by the first rule whose glob they match; unmatched ones under ``other`` (F8)."""
    out: dict[str, list[str]] = {g: [] for g in [*rules, "other"]}
    for c in columns:
        out[next((g for g, globs in rules.items() if any(fnmatch.fnmatchcase(c, x) for x in globs)), "other")].append(c)
    return out


# --- alleles ---------------------------------------------------------------------------------------------------------

#: Texts that stand for a missing allele.
NULL_ALLELES = ("", "nan", "none", "null", "na")


def alleles(c: Column | str) -> Column:
    """Parts of a list of alleles split at commas and semicolons, distinct, by (start, end, text), unreadable ones last."""
    clean = F.transform(F.split(_c(c), "[,;]"), lambda a: F.trim(a, F.lit(" \"'")))
    real = F.filter(F.array_distinct(clean), lambda a: ~F.lower(a).isin(*NULL_ALLELES))

    def order(a: Column) -> Column:
        pos = lambda g: F.coalesce(F.nullif(F.regexp_extract(a, r"(\d+)(?:_(\d+))?", g), F.lit("")).cast("int"), F.lit(2147483647))
        return F.struct(pos(1).alias("s"), pos(2).alias("e"), a.alias("t"))

    return F.transform(F.array_sort(F.transform(real, order)), lambda x: x["t"])


def locus(c: Column | str) -> Column:
    """Locus prefix (letters before the first underscore) of an allele, null if it has none."""
    return F.nullif(F.regexp_extract(F.trim(_c(c)), "^(CA|TA|RA)_", 1), F.lit(""))


def well_formed_alleles(c: Column | str) -> Column:
    """Whether every allele starts with a locus and two positions."""
    return F.forall(F.split(_c(c), ","), lambda a: a.rlike(r"^(CA|TA|RA)_\d+_\d+"))


def joint_alleles(c: Column | str) -> Column:
    """Alleles of a joint clone id: split at ``@`` without missing ones."""
    return F.filter(F.split(F.trim(_c(c)), "@"), lambda a: ~F.lower(F.trim(a)).isin(*NULL_ALLELES))


def counts_of(c: Column | str) -> Column:
    """Map of ``k:n;k:n`` to numbers."""
    return F.transform_values(F.str_to_map(_c(c), F.lit(";"), F.lit(":")), lambda k, v: v.cast("long"))


# --- arithmetic ------------------------------------------------------------------------------------------------------

def ratio(a: Column | str, b: Column | str, otherwise: float | None = 0.0) -> Column:
    """a / b, ``otherwise`` where b is zero or either is null."""
    return F.coalesce(_c(a) / F.nullif(_c(b), F.lit(0)), F.lit(otherwise))


def finite(c: Column | str) -> Column:
    """The number, or null where it is NaN or infinite (F16). Used before every aggregate, since Spark keeps NaN in them."""
    d = _c(c).cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def signed_round(c: Column | str, digits: int) -> Column:
    """Rounded to ``digits`` decimals; what rounds to zero keeps its sign, as in SQL engines that round in binary."""
    return F.signum(_c(c)) * F.round(F.abs(_c(c)), digits)


def clamp(c: Column | str, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(_c(c), low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def phrases_in(text: Column | str, phrases: Sequence[str]) -> Column:
    """Those of ``phrases`` that the text contains, whatever the case."""
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(_c(text)), F.lower(p)))


# --- distributions and vectors ---------------------------------------------------------------------------------------

def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def entropy(counts: Column | str) -> Column:
    """Natural-log entropy of an array of counts over its positive ones; 0 if fewer than two are positive."""
    pos = F.filter(F.transform(_c(counts), lambda x: x.cast("double")), lambda x: x > 0)
    total = _sum(pos)
    return F.when(F.size(pos) > 1, -_sum(F.transform(pos, lambda x: x / total * F.ln(x / total)))).otherwise(0.0)


def simpson(counts: Column | str) -> Column:
    """1 - sum of squared shares over positive counts; 0 if fewer than two are positive."""
    pos = F.filter(F.transform(_c(counts), lambda x: x.cast("double")), lambda x: x > 0)
    total = _sum(pos)
    return F.when(F.size(pos) > 1, 1.0 - _sum(F.transform(pos, lambda x: (x / total) * (x / total)))).otherwise(0.0)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def l1(a: Column | str, b: Column | str) -> Column:
    """Sum of absolute differences; empty vectors give 0, non-finite terms count 0."""
    return _sum(F.transform(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: F.coalesce(finite(d), F.lit(0.0))))


def l2(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance, with the rules of :func:`l1`."""
    return F.sqrt(_sum(F.transform(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), lambda d: F.coalesce(finite(d), F.lit(0.0)))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine, 0 where a vector has no length."""
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jensen_shannon(p: Column | str, q: Column | str) -> Column:
    """Jensen-Shannon divergence (natural log) of two equally long share vectors; terms of share 0 count 0."""
    def half(a: Column, b: Column) -> Column:
        return _sum(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.ln(x / ((x + y) / 2))).otherwise(0.0)))

    return 0.5 * half(_c(p), _c(q)) + 0.5 * half(_c(q), _c(p))


def softmax_weight(distance: Column | str, over: Column | None = None) -> Column:
    """exp(-d) (F21); divide by its window sum per row group to get the softmax."""
    return F.exp(-_c(distance))


def average_rank(value: Column | str, partition: Sequence[Column | str]) -> Column:
    """Rank within ``partition`` with ties averaged."""
    from pyspark.sql import Window

    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(_c(value))) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, _c(value))) - 1) / 2


def quadrant(x: Column | str, y: Column | str, partition: Sequence[Column | str]) -> Column:
    """``left_low`` .. ``right_high`` by thirds of the average-tie percentile rank of x and y."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    third = lambda v, names: F.when(v * 3 <= n, names[0]).when(v * 3 <= 2 * n, names[1]).otherwise(names[2])
    return F.concat_ws("_", third(average_rank(x, partition), ("left", "middle", "right")), third(average_rank(y, partition), ("low", "mid", "high")))
