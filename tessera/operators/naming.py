"""Which known person a name means: lookups in tiers, the nearest spelling, and an index of titles."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fuzzy, names
from tessera.functions import text as ft
from tessera.operators.sequence import top_per_group
from tessera.plans.workspace import Workspace

#: Names of two lengths meet by their subsequences, if a name has at most so many and all are fewer than this part of the pairs; about so many share a rare gram.
SUBSEQUENCES, GRAM_PAIRS = 1000, 0.05


def _grams(c: Column) -> Column:
    """Pairs of neighbouring characters, and of up to three characters also the single ones, each with the number of its occurrence."""
    chars = F.split(c, "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    every = F.when(F.char_length(c) <= 3, F.concat(pairs, chars)).otherwise(pairs)
    return F.transform(every, lambda g, i: F.concat(g, F.lit(":"), F.size(F.filter(F.slice(every, F.lit(1), i + 1), lambda h: h == g)).cast("string")))


def _posted(rows: DataFrame, form: str, least: float | Column, often: DataFrame) -> DataFrame:
    """``rows`` with ``_g``, one of their rarest grams: as many that strings which are ``least`` alike share one.

    Of strings of n and m characters so alike, ``3 * l - 1 - (n + m)`` pairs of
    neighbours at least are pairs in both, with l the common subsequence.
    """
    n = F.char_length(form)
    shared = F.ceil((3 * least / 200 - 1) * (n + F.ceil(n * least / (200 - least) - 1e-9)) - 1 - 1e-9)
    every = rows.withColumn("_all", F.size(_grams(F.col(form)))).withColumn("_g", F.explode(_grams(F.col(form)))).join(F.broadcast(often), "_g")
    keys = [c for c in rows.columns]
    sorted_ = every.groupBy(*keys, "_all").agg(F.array_sort(F.collect_list(F.struct("_df", "_g"))).alias("_s"))
    most = F.when(n <= 3, F.col("_all")).otherwise(F.least(F.col("_all"), F.col("_all") - F.greatest(shared, F.lit(1)) + 1))
    return sorted_.select(*keys, F.explode(F.transform(F.slice("_s", F.lit(1), most.cast("int")), lambda x: x["_g"])).alias("_g"))


def _least_common(n: int, m: int, least: float) -> int:
    """The length of the common subsequence with which strings of n and m characters are ``least`` alike."""
    return math.ceil(least * (n + m) / 200 - 1e-9)


def _of_length(rows: DataFrame, form: str, lengths: Iterable[int]) -> DataFrame:
    return rows.where(F.array_contains(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), F.char_length(form)))


def _thinned(rows: DataFrame, form: str, left: dict[int, set[int]]) -> DataFrame:
    """``rows`` with ``_k``, a number for each subsequence of ``form`` of the lengths that ``left`` has for strings of its length."""

    @F.pandas_udf("array<bigint>")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: np.array([size << 32 | zlib.crc32("".join(c).encode()) for size in left[len(s)] for c in itertools.combinations(s, size)]))

    return _of_length(rows, form, left).withColumn("_k", F.explode(F.array_distinct(keys(form))))


def _thinned_pairs(a: DataFrame, b: DataFrame, pairs: list[tuple[int, int, int]]) -> DataFrame:
    """``a`` with (_id, _b) of strings that share a subsequence; ``pairs`` has the lengths of both and of that."""
    left, right = defaultdict(set), defaultdict(set)
    for n, m, size in pairs:
        left[n].add(size)
        right[m].add(size)
    return _thinned(a, "_a", dict(left)).join(_thinned(b, "_b", dict(right)).hint("merge"), "_k").select(*a.columns, "_id", "_b")


def _gram_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """``a`` (_a, and how like it others must be: _t) with (_id, _b) of strings that share one of their rarest grams."""
    often = a.select(F.explode(_grams(F.col("_a"))).alias("_g")).unionAll(b.select(F.explode(_grams(F.col("_b"))).alias("_g"))).groupBy("_g").agg(F.count("*").alias("_df"))
    return _posted(a, "_a", F.col("_t"), often).join(_posted(b, "_b", least, often).hint("merge"), "_g").select(*a.columns, "_id", "_b")


def _nearest(pairs: DataFrame, least: float) -> DataFrame:
    """(_a, _id, similarity) of each string's nearest among ``pairs``."""
    la, lb = F.char_length("_a"), F.char_length("_b")
    # the ratio is 200 times the common subsequence over both lengths, and that is no longer than the shorter one
    shared = pairs.where(200 * F.least(la, lb) >= least * (la + lb)).distinct()
    scored = shared.withColumn("similarity", fuzzy.fuzz_ratio("_a", "_b")).where(F.col("similarity") >= least)
    return top_per_group(scored, ["_a"], [F.desc("similarity"), F.col("_id")]).select("_a", "_id", "similarity")


def nearest_names(rows: DataFrame, known: DataFrame, name: str, id_: str, known_name: str, least: float, sorted_tokens: bool = False) -> DataFrame:
    """(name, id, similarity) of the known name nearest to each distinct name, if its ratio reaches ``least`` (80 or more); ties by id.

    Names are alike if they have a long subsequence in common.  First those are
    found that are equal but for a character on either side, by what is left
    without it; that grows with the names, not with their pairs, however alike all
    are.  Only names for which another may be as near go on, to known ones of such
    lengths: by all subsequences that are long enough, where these are fewer than
    the pairs, else by grams.  Two strings whose ratio is 80 or more share pairs of
    neighbouring characters (or, of five characters in all, single ones), so only
    names that share one of their rarest are compared.
    """
    if least < 80:
        raise ValueError("names that are less alike than 80 may share nothing")
    workspace = Workspace(rows.sparkSession, "names")
    order = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    form = order if sorted_tokens else lambda c: c
    named = workspace.save(rows.select(F.col(name).alias("name")).where(F.coalesce(F.trim("name"), F.lit("")) != "").distinct().withColumn("_a", form(F.col("name"))))
    b = known.select(F.col(id_).alias("_id"), F.col(known_name).alias("_b")).where(F.coalesce(F.trim("_b"), F.lit("")) != "")
    b = workspace.save(b.groupBy(form(F.col("_b")).alias("_b")).agg(F.min("_id").alias("_id")))
    a = named.select("_a").distinct()
    counts = lambda rows, *by: {tuple(r)[:-1]: r["count"] for r in rows.groupBy(*by).count().collect()}
    la, there = F.char_length("_a"), {m: c for (m,), c in counts(b, F.char_length("_b")).items()}

    pairs = [(n, m, max(_least_common(n, m, least), n - 1, m - 1)) for (n,) in counts(a, la) for m in (n - 1, n, n + 1) if m in there]
    close = workspace.save(_nearest(_thinned_pairs(a, b, [(n, m, size) for n, m, size in pairs if size <= min(n, m)]), least))
    # names that lack two characters of a known one come next
    still = a.join(close.hint("merge"), "_a", "left").where(F.col("similarity").isNull() | (F.col("similarity") <= 100 * la / (la + 1) + 1e-9))
    still = workspace.save(still.select("_a", F.coalesce("similarity", F.lit(least)).alias("_t")))
    thinned, by_grams = [], []
    for (n, t), asked in counts(still, la, "_t").items():
        for m, size in ((m, _least_common(n, m, t)) for m in there):
            if size <= min(n, m) and size < max(n, m) - 1:
                made = math.comb(n, size), math.comb(m, size)
                few = max(made) <= SUBSEQUENCES and asked * made[0] + there[m] * made[1] < GRAM_PAIRS * asked * there[m]
                (thinned if few else by_grams).append((n, m, size))
    far = _gram_pairs(_of_length(still, "_a", {n for n, _, _ in by_grams}), _of_length(b, "_b", {m for _, m, _ in by_grams}), least)
    if thinned:
        far = far.union(_thinned_pairs(still, b, thinned))
    # the others of these were found before
    lb = F.char_length("_b")
    size = F.ceil(F.col("_t") * (la + lb) / 200 - 1e-9)
    far = far.where((size <= F.least(la, lb)) & (size < F.greatest(la, lb) - 1)).drop("_t")
    best = top_per_group(close.union(_nearest(far, least)), ["_a"], [F.desc("similarity"), F.col("_id")])
    return named.join(best.hint("merge"), "_a").select("name", F.col("_id").alias("id"), "similarity")


def resolve(rows: DataFrame, known: DataFrame, name: str, least: float = 88.0) -> DataFrame:
    """``rows`` with ``resolved`` (an id of ``known``: id, name) and ``tier``.

    Tier 0: the normalised names are equal.  1: only one known person has the
    surname and the first initial.  2: the nearest by the ratio of sorted tokens,
    honorifics left out, from ``least``.  Of equal names the smallest id counts.
    """
    bare = lambda c: ft.fold(F.regexp_replace(ft.strip_honorifics(c), r"[^\p{L}\p{N}\s'-]", " "))
    people = known.select("id", "name").where(F.coalesce(F.trim("name"), F.lit("")) != "").withColumn("_bare", bare(F.col("name")))
    exact = people.groupBy(ft.normalize_label(F.col("name")).alias("_k0")).agg(F.min("id").alias("_v0"))
    initial = lambda c: F.concat_ws("|", F.element_at(F.split(c, " "), -1), F.substring(c, 1, 1))
    sole = people.groupBy(initial(F.col("_bare")).alias("_k1")).agg(F.min("id").alias("_v1"), F.count("*").alias("_c")).where("_c = 1").drop("_c")
    asked = rows.select(F.col(name).alias("_n")).where(F.col("_n").isNotNull()).distinct().withColumn("_b", bare(F.col("_n")))
    # names come from files that are much smaller than they are, so Spark would take them for small and send them to the driver
    exact, sole = exact.hint("merge"), sole.hint("merge")
    asked = asked.join(exact, ft.normalize_label(F.col("_n")) == F.col("_k0"), "left").join(sole, (initial(F.col("_b")) == F.col("_k1")) & (F.col("_b") != ""), "left")
    asked = Workspace(rows.sparkSession, "asked").save(asked.select("_n", "_b", "_v0", "_v1"))
    open_ = asked.where("_v0 is null and _v1 is null")
    near = nearest_names(open_, people, "_b", "id", "_bare", least, sorted_tokens=True).select(F.col("name").alias("_k2"), F.col("id").alias("_v2"))
    found = asked.join(near.hint("merge"), (F.col("_b") == F.col("_k2")) & F.col("_v0").isNull() & F.col("_v1").isNull(), "left")
    tier = F.when(F.col("_v0").isNotNull(), 0).when(F.col("_v1").isNotNull(), 1).when(F.col("_v2").isNotNull(), 2)
    found = found.select("_n", F.coalesce("_v0", "_v1", "_v2").alias("resolved"), tier.alias("tier"))
    return rows.join(found.hint("merge"), F.col(name) == F.col("_n"), "left").drop("_n")


def title_index(papers: DataFrame, recent: int = 25) -> DataFrame:
    """(key, display): how speakers of the ``recent`` latest order papers (sitting, speakers) are shown, the latest first for each key."""
    few = papers.where(F.size("speakers") > 0).orderBy(F.desc("sitting"), "paper").limit(recent)
    said = few.select("sitting", "paper", F.posexplode("speakers").alias("_p", "s")).where("trim(s.name) <> ''")
    title, name = F.coalesce(F.trim("s.title"), F.lit("")), F.trim("s.name")
    own = F.array(name, F.when(title != "", F.concat_ws(" ", title, name)), F.when(F.lower(title).rlike("^hon|honourable"), F.concat(F.lit("hon "), name)))
    rows = said.select("sitting", "paper", "_p", names.with_title(title, name).alias("display"), F.posexplode(F.array_compact(own)).alias("_q", "k")).withColumn("key", ft.normalize_label(F.col("k")))
    # a key without its honorific counts only where no speaker has it as it stands
    both = rows.withColumn("_own", F.lit(0)).unionByName(rows.withColumn("key", names.without_title(F.col("key"))).withColumn("_own", F.lit(1)))
    best = top_per_group(both.where("key <> ''"), ["key"], [F.col("_own"), F.desc("sitting"), F.col("paper"), F.col("_p"), F.col("_q")])
    return best.select("key", "display")


def shown_names(speakers: DataFrame, index: DataFrame) -> DataFrame:
    """(id, name) of speakers (id, full_name, normalized_name, title): the index's form for the first of their keys that it has, else their own."""
    keyed = speakers.select("id", F.posexplode(names.keys(F.col("full_name"), F.col("normalized_name"), F.col("id"))).alias("_p", "key"))
    found = keyed.join(index, "key").groupBy("id").agg(F.min_by("display", "_p").alias("_d"))
    full = F.trim(F.coalesce("full_name", F.lit("")))
    plain = (full == "") | (full == F.lower(full)) | F.startswith(full, F.lit("s_"))
    norm = F.trim(F.coalesce("normalized_name", F.lit("")))
    norm = F.when(F.startswith(norm, F.lit("s_")), norm).when(F.startswith("id", F.lit("s_")), names.guessed_from_id(F.col("id"))).otherwise(norm)
    own = F.when(plain, names.shown(F.lit(None), F.coalesce(F.nullif(norm, F.lit("")), F.nullif(full, F.lit(""))), F.col("id"))).otherwise(full)
    titled = F.when(F.coalesce(F.trim("title"), F.lit("")).eqNullSafe("") | F.contains(F.lower(own), F.lit("honourable")), own).otherwise(names.with_title(F.col("title"), own))
    return speakers.join(found, "id", "left").select("id", F.coalesce("_d", titled).alias("name"))


def paper_roles(papers: DataFrame) -> DataFrame:
    """(paper, name, role, kind): every single role of the speakers in order papers; honours aren't roles."""
    from tessera.functions import vocabulary as v

    rows = papers.select("paper", F.explode("speakers").alias("s")).select("paper", F.trim("s.name").alias("name"), F.explode(ft.role_labels(F.col("s.role"))).alias("role"))
    return rows.where((F.col("name") != "") & ~F.lower("role").isin(v.HONOURS)).select("paper", "name", "role", ft.role_kind(F.col("role")).alias("kind"))
