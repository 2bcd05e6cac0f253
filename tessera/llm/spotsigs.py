"""SpotSigs fingerprints (Theobald, Siddharth and Paepcke, 2008), in DataFrame functions only.

Wherever a common word (an antecedent) stands, the next ``CHAIN`` content words
after it form a signature.  A text's fingerprint is its set of signatures, as
sorted 32-bit numbers in hexadecimal.  Texts are compared by the Jaccard
coefficient of their sets; sets whose sizes rule a wanted coefficient out are not
compared, and near duplicates are looked for within partitions of set length:
a set of one partition can only be near sets of that and the adjacent ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.plans.workspace import Workspace

CHAIN = 2
#: Documents in a range of ids that is put in order in one go, about; beyond RANGES of them, which bound the plan, ranges grow and their sorts spill.
RANGE, RANGES = 500, 8192
#: Signatures in fewer sets than this need no place in the order of frequency; of the others the most frequent, at most so many, have one.
OFTEN_FROM, OFTEN_LIMIT = 16, 1 << 18
#: Most rows that are broadcast.
BROADCAST_ROWS = 250_000
#: Members of a list that are compared with as many others in one go.
BLOCK = 256
#: Further members of a list that all are compared with where its first and last don't connect it.
PIVOTS = 4
#: Words of 64 bits in a parity sketch.
SKETCH = 4
#: Sets of more signatures than this have a longer sketch too, of about a bit for each, as one of SKETCH words can't tell them apart.
LONG = 96 * SKETCH
#: Common words of English, French, German and Spanish.
ANTECEDENTS = """
a an and are as at be been but by can did do for from had has have he her his if in is it its not of on or she so that the
their them then there they this to was we were what when which who will with would you
au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour qu que qui sa sans ses
son sont sur un une vous
als am auch auf aus bei das dem den der die ein eine einen einer er es für ich im ist mit nach nicht noch nur oder sich sie
sind um und von vor war wie wir zu zum zur über
al como con del el ella ellos esta este fue ha hay las lo los más muy no o para pero por se sin sobre su sus te una y ya
""".split()


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda variable isn't computed again for each element of another array."""
    return F.transform(F.array(value), use)[0]


def signatures(text: Column) -> Column:
    """Sorted distinct signatures; of a text without any, one for its words as a whole, and of a text without words, one for itself."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    is_spot = lambda w: w.isin(ANTECEDENTS)

    def chains(w):
        spots = F.filter(F.transform(w, lambda x, i: F.when(is_spot(x), i)), lambda i: i.isNotNull())
        content = F.filter(w, lambda x: ~is_spot(x))
        parts = F.struct(w.alias("w"), spots.alias("s"), content.alias("c"))

        def signed(p):
            # before the j-th spot, at i, stand i - j content words
            sign = lambda i, j: F.when(i - j + CHAIN <= F.size(p["c"]), F.xxhash64(F.get(p["w"], i), *[F.get(p["c"], i - j + n) for n in range(CHAIN)]).bitwiseAND(F.lit(0xFFFFFFFF)))
            return F.filter(F.transform(p["s"], sign), lambda x: x.isNotNull())

        return let(parts, signed)

    whole = lambda w: F.when(F.size(w) > 0, F.xxhash64(F.array_join(w, " "), F.lit(1))).otherwise(F.xxhash64(text, F.lit(2))).bitwiseAND(F.lit(0xFFFFFFFF))
    found = let(words, lambda w: let(chains(w), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(whole(w)))))
    return F.sort_array(F.array_distinct(found))


def fingerprint(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def pruned_jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard coefficient of two sets; 0 without comparing them where their sizes keep it below ``least``."""
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (F.size(a) + F.size(b) - shared)
    apart = F.least(F.size(a), F.size(b)) < F.lit(least) * F.greatest(F.size(a), F.size(b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when(apart, 0.0).otherwise(exact)


def _place(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are not above a key, by halving."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, n: F.when((at + n <= len(cuts)) & (F.get(table, at + n - 1) <= key), at + n).otherwise(at))


def with_next(docs: DataFrame, doc_id: str, text: str, derive) -> DataFrame:
    """``docs`` with ``next_text``, ``derived`` (of ``text``) and ``next_derived`` of the following row.

    Rows are ordered by id (null first), then by text; the first follows the
    last.  Ranges of ids are put in order separately, each with a copy of the
    next range's first row at its end.
    """
    keyed = docs.withColumn("_key", F.coalesce(F.col(doc_id), F.lit(-(1 << 63)))).withColumn("_last", F.lit(False))
    ids = keyed.select("_key")
    parts = min(RANGES, max(1, math.ceil(ids.count() / RANGE)))
    cuts = ids.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    keyed = keyed.withColumn("_range", _place(F.col("_key"), sorted(set(cuts))))
    heads = sorted((r["_range"], r["key"]) for r in keyed.groupBy("_range").agg(F.min("_key").alias("key")).collect())
    firsts = [key for _, key in heads]
    # the first key of a range goes to the range before it, the very first one to the last
    turn = F.element_at(F.array(*[F.lit(heads[i - 1][0]) for i in range(len(heads))]), _place(F.col("_key"), firsts)) if heads else F.lit(0)
    first = keyed.where(F.col("_key").isin(firsts)).groupBy("_key").agg(F.min(text).alias("least"), F.max(F.col(text).isNull()).alias("null"))
    copies = first.select("_key", F.when(~F.col("null"), F.col("least")).alias(text), turn.cast("int").alias("_range"), F.lit(True).alias("_last"))
    every = keyed.unionByName(copies, allowMissingColumns=True)
    order = Window.partitionBy("_range").orderBy("_last", "_key", text)
    every = every.withColumn("next_text", F.lead(text).over(order)).withColumn("derived", derive(F.coalesce(F.col(text), F.lit(""))))
    return every.withColumn("next_derived", F.lead("derived").over(order)).where("not _last").drop("_key", "_last", "_range")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's text.  A null text counts as
    empty.  Rows of equal id are ordered by text.  Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    found = with_next(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "doc_id", "text", signatures)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    found = found.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    found = found.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "derived", "next_derived", signatures(F.col("edited")).alias("of_edited"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("derived")).alias("fingerprint"),
        fingerprint(F.col("of_edited")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("derived"), F.col("of_edited")).alias("near_edited"),
        pruned_jaccard(F.col("derived"), F.col("next_derived")).alias("near_next"),
    )


def _bounds(most: int, least: float) -> list[int]:
    """First sizes of the partitions of set length: what is near a set of one is in that one or an adjacent one."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, math.floor(out[-1] / least + 1e-9) + 1))
    return out


def _sketch(signs: Column) -> list[Column]:
    """The parities of the numbers of signatures by their lowest bits, as s0, s1, ..."""
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda i: F.aggregate(signs, F.lit(0).cast("long"), lambda acc, s: F.when(F.shiftright(s, 6).bitwiseAND(F.lit(SKETCH - 1)) == i, acc.bitwiseXOR(bit(s))).otherwise(acc))
    return [word(i).alias(f"s{i}") for i in range(SKETCH)]


def _long_sketches(sets: DataFrame) -> DataFrame:
    """(set, n, w) of the sets of more than LONG signatures: parities of the numbers of signatures by their lowest bits, in 2^k words of 64 bits, n bits at least.

    w is null where a word got no signature at all.
    """
    words = F.call_function("shiftleft", F.lit(1), F.ceil(F.log2(F.col("n") / 64)).cast("int"))
    each = sets.where(F.col("n") > LONG).select("set", "n", words.alias("words"), F.explode("signs").alias("s"))
    at = F.shiftright("s", 6).bitwiseAND(F.col("words") - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)))
    found = each.groupBy("set", "n", "words", at.alias("at")).agg(F.bit_xor(bit).alias("x")).groupBy("set", "n", "words").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("w"))
    return found.select("set", "n", F.when(F.size("w") == F.col("words"), F.transform("w", lambda v: v["x"])).alias("w"))


def _differ(x: Column, y: Column) -> Column:
    """In how many bits two such sketches differ, the longer one folded to the length of the other; null if one is missing."""
    xor = lambda p, q: p.bitwiseXOR(q)
    half = lambda w: F.size(w) / 2
    folded = lambda w: F.zip_with(F.slice(w, F.lit(1), half(w).cast("int")), F.slice(w, half(w).cast("int") + 1, half(w).cast("int")), xor)
    a, b = F.when(F.size(x) > F.size(y), folded(x)).otherwise(x), F.when(F.size(y) > F.size(x), folded(y)).otherwise(y)
    return F.when(x.isNotNull() & y.isNotNull() & (F.size(a) == F.size(b)), F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(xor(p, q))), F.lit(0), lambda acc, v: acc + v))


def _most(often: DataFrame, most: int) -> DataFrame:
    """The rows of highest ``df``, at most so many: all from the smallest class of df on that fits, by classes of a quarter power of 2."""
    of = F.floor(4 * F.log2("df"))
    from_, held = None, 0
    for r in sorted(often.groupBy(of.alias("class")).agg(F.count("*").alias("c")).collect(), key=lambda r: -r["class"]):
        held += r["c"]
        if held > most:
            break
        from_ = r["class"]
    return often.where(of >= from_) if from_ is not None else often.where("false")


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _linked(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, least: float, workspace: Workspace) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard coefficient of ``least`` or more; pairs of long sets are first compared by their sketches, which can only reject."""
    drawn = lambda x: sketches.select(F.col("set").alias(x), F.col("n").alias(f"{x}_n"), F.col("w").alias(f"{x}_w")).hint("merge")
    apart = (1 + least) * _differ(F.col("a_w"), F.col("b_w")) > (1 - least) * (F.col("a_n") + F.col("b_n")) + 1e-9
    pairs = workspace.save(pairs.join(drawn("a"), "a", "left").join(drawn("b"), "b", "left").where(~F.coalesce(apart, F.lit(False))).select("a", "b"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    own = workspace.save(sets.select("set", "signs").join(wanted, "set"))
    whole = lambda x, s: own.select(F.col("set").alias(x), F.col("signs").alias(s))
    both = pairs.join(whole("a", "x").hint("merge"), "a").join(whole("b", "y").hint("merge"), "b")
    found = workspace.save(both.where(pruned_jaccard(F.col("x"), F.col("y"), least) >= least - 1e-9).select("a", "b"))
    workspace.drop(pairs, own)
    return found


def _sized(signs: str, bounds: list[int]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.size(signs)))


def near_duplicates(docs: DataFrame, text: str = "text", least: float = 0.8, workspace: Workspace | None = None) -> DataFrame:
    """(fingerprint, print, group) of every distinct fingerprint that is near another: groups of Jaccard ``least`` or more, linked through.

    print is the fingerprint's MD5, group the least print of its group.  A set of
    n is posted to the lists of its first ``n - ceil(least * n) + 1`` signatures,
    the rarest first; every near set shares one of them.  A list holds the sets
    of one partition of length, and as visitors those of the next shorter one.
    In each list all sets are compared with its first and last one, then, where
    that leaves sets unconnected, with PIVOTS more; what is still unconnected is
    compared pair by pair, block by block, by a parity sketch that can only
    reject pairs below ``least``, those of long sets by a longer one, and then
    whole.  No list is cut off.
    """
    workspace = workspace or Workspace(docs.sparkSession, "spotsigs")
    # signatures as 32-bit numbers in the same order
    sets = docs.select(F.transform(signatures(F.coalesce(F.col(text), F.lit(""))), lambda s: (s - (1 << 31)).cast("int")).alias("signs")).distinct()
    # the table is written once, so each set keeps its number
    sets = workspace.save(sets.select(F.monotonically_increasing_id().alias("set"), F.size("signs").alias("n"), "signs", *_sketch(F.col("signs"))))
    bounds = _bounds(sets.agg(F.max("n")).first()[0] or 1, least)
    sketches = workspace.save(_long_sketches(sets))
    small = ["set", "n", *[f"s{i}" for i in range(SKETCH)]]
    near = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y) - 1e-9

    def alike(a, b):
        """Linked sets have (1 + least) * d <= (1 - least) * (n + m) for d signatures in one of them only, and sketches differ in d bits at most."""
        differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)), F.lit(0))
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        return near(n, m) & ((1 + least) * differ <= (1 - least) * (n + m) + 1e-9)

    often = workspace.save(sets.select(F.explode("signs").alias("sign")).groupBy("sign").agg(F.count("*").alias("df")).where(F.col("df") >= OFTEN_FROM))
    late = sets.select("set", F.explode("signs").alias("sign")).join(F.broadcast(_most(often, OFTEN_LIMIT)), "sign")
    late = late.groupBy("set").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "sign"))), lambda x: x["sign"]).alias("late"))
    last = F.coalesce("late", F.array().cast("array<int>"))
    reach = (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int")
    prefix = F.slice(F.concat(F.array_except("signs", last), last), F.lit(1), reach)
    every = workspace.save(sets.select("set", "n", "signs").join(late.hint("merge"), "set", "left").select("set", _sized("signs", bounds).alias("part"), F.explode(prefix).alias("sign")))
    common = every.groupBy("sign").agg(F.count("*").alias("c")).where("c > 1").select("sign")
    posted = workspace.save(every.join(common.hint("merge"), "sign"))
    workspace.drop(often, every)
    both = posted.withColumn("native", F.lit(True)).unionByName(posted.withColumn("part", F.col("part") + 1).withColumn("native", F.lit(False)))
    ends = [F.min(F.when(F.col("native"), F.col("set"))).alias("low"), F.max(F.when(F.col("native"), F.col("set"))).alias("high")]
    shared = both.groupBy("sign", "part").agg(F.count("*").alias("c"), *ends).where("c > 1 and low is not null")
    lists = workspace.save(both.join(shared.hint("merge"), ["sign", "part"]))
    workspace.drop(posted)
    stars = lists.select("set", F.explode(F.array_distinct(F.array("low", "high"))).alias("end")).where("set <> end")
    stars = stars.select(F.least("set", "end").alias("a"), F.greatest("set", "end").alias("b")).distinct()
    drawn = sets.select(small).hint("merge")
    stars = stars.join(drawn.alias("x"), F.col("a") == F.col("x.set")).join(drawn.alias("y"), F.col("b") == F.col("y.set")).where(alike("x", "y")).select("a", "b")
    links = _linked(stars, sets, sketches, least, workspace)
    parts = connected_components(links, "a", "b", workspace)

    def unconnected():
        """Members of the lists of more than one component, with their sketches and the number of blocks."""
        named = lists.where("c > 2").select("sign", "part", "set", "native", "c").join(parts.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        mixed = named.groupBy("sign", "part").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sign", "part")
        rest = named.join(mixed.hint("merge"), ["sign", "part"], "left_semi")
        return workspace.save(rest.join(sets.select(small), "set").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")))

    apart = lambda a, b: (F.col(f"{a}.component") != F.col(f"{b}.component")) & alike(a, b)
    pair = [F.least("a.set", "b.set").alias("a"), F.greatest("a.set", "b.set").alias("b")]
    rest = unconnected()
    drawn = [F.min(F.when(F.col("native"), F.struct(F.xxhash64(F.lit(i), "set").alias("h"), "set", "n", "component", *[f"s{j}" for j in range(SKETCH)]))).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = rest.groupBy("sign", "part").agg(*drawn).select("sign", "part", F.explode(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("p")).select("sign", "part", "p.*").distinct()
    some = rest.alias("a").join(workspace.save(pivots).alias("b"), ["sign", "part"]).where(apart("a", "b")).select(*pair).distinct()
    more = _linked(some, sets, sketches, least, workspace)
    if more.limit(1).count():
        links = workspace.save(links.union(more))
        parts = connected_components(links, "a", "b", workspace)
        workspace.drop(rest)
        rest = unconnected()
    rest = workspace.save(rest.withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    one = rest.withColumnsRenamed({"own": "i", "other": "j"}).where("native").alias("a")
    two = rest.withColumnsRenamed({"own": "j", "other": "i"}).alias("b")
    pairs = one.join(two, ["sign", "part", "i", "j"]).where((~F.col("b.native") | (F.col("a.set") < F.col("b.set"))) & apart("a", "b"))
    more = _linked(pairs.select(*pair).distinct(), sets, sketches, least, workspace)
    if more.limit(1).count():
        parts = connected_components(links.union(more), "a", "b", workspace)
    found = parts.join(sets, F.col("node") == F.col("set")).select("component", fingerprint(F.transform("signs", lambda s: s.cast("long") + (1 << 31))).alias("fingerprint"))
    found = workspace.save(found.withColumn("print", F.md5("fingerprint")))
    workspace.drop(sets, sketches, lists, rest)
    return found.join(found.groupBy("component").agg(F.min("print").alias("group")), "component").select("fingerprint", "print", "group")


def grouped(found: DataFrame, docs: DataFrame, text: str = "text", least: float = 0.8, workspace: Workspace | None = None) -> DataFrame:
    """``fingerprints`` of ``docs`` with ``group``: equal for documents that near fingerprints connect, equal ones included."""
    near = (workspace or Workspace(docs.sparkSession, "spotsigs")).save(near_duplicates(docs, text, least, workspace).select("print", "group"))
    joined = found.drop("group").withColumn("print", F.md5("fingerprint")).join(_few(near), "print", "left")
    return joined.withColumn("group", F.coalesce("group", "print")).drop("print")
