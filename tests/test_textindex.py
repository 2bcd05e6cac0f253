"""Stems, and full-text search against positions read from the texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import stemming
from tessera.operators import textindex

#: Published examples of the stemming rules.
STEMS = """consigned>consign consignment>consign consistency>consist consistently>consist consolatory>consolatori consoled>consol consolidating>consolid consolingly>consol conspicuously>conspicu
conspiracy>conspiraci conspirators>conspir constables>constabl constancy>constanc knackeries>knackeri knavish>knavish kneaded>knead kneeled>kneel knees>knee knightly>knight knitted>knit knocker>knocker
hopping>hop hoping>hope bees>bee gas>gas ties>tie cries>cri by>by say>say generate>generat generally>general generic>generic university>univers relational>relat hopefulness>hope formalize>formal agreed>agre feed>feed
luxuriated>luxuri skies>sky dying>die news>news inning>inning youth>youth boyish>boyish flying>fli kiwis>kiwi this>this gaps>gap possibly>possibl communism>communism national>nation happiness>happi
sensational>sensat controlled>control rolling>roll adjustable>adjust replacement>replac adoption>adopt o'neil's>o'neil a>a""".split()


def test_stems(spark):
    pairs = [tuple(p.split(">")) for p in STEMS]
    got = spark.createDataFrame(pairs, "word string, stem string").withColumn("got", stemming.stem(F.col("word"))).where("got is distinct from stem").collect()
    assert got == []


def places(tokens, unit):
    return [p for p in range(len(tokens)) if all(p + at < len(tokens) and tokens[p + at] == t for t, at in unit)]


def rank(tokens, wanted, unwanted):
    """Cover density by trying every stretch."""
    if any(places(tokens, u) for u in unwanted):
        return None
    spans = [[(p + 1, p + u[-1][1] + 1) for p in places(tokens, u)] for u in wanted]
    if not all(spans):
        return None
    ok = lambda a, b: all(any(a <= s and e <= b for s, e in own) for own in spans)
    n = len(tokens)
    best = [(a, b) for a in range(1, n + 1) for b in range(a, n + 1) if ok(a, b) and not (a < b and ok(a + 1, b)) and not (a < b and ok(a, b - 1))]
    size = sum(u[-1][1] + 1 for u in wanted)
    return sum(0.1 / (1 + max(0, b - a + 1 - size)) for a, b in best)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = "the of running runs Runner budget Budgets debate tax-paying Über co2 über".split()
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", " -"]) for _ in range(rng.choice([1, 5, 25])))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "... !"), (n + 3, "budget " * 300 + "debate")]


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


@pytest.fixture(scope="module")
def simple(spark, tmp_path_factory):
    docs = spark.createDataFrame(corpus(), "id long, body string")
    return textindex.build(docs, "id", "body", str(tmp_path_factory.mktemp("index") / "simple"), stemmed=False, buckets=7)


ONE = lambda *words: [[(w, 0)] for w in words]
PHRASE = lambda *words: [(w, i) for i, w in enumerate(words)]


@pytest.mark.parametrize(
    ("query", "alternatives"),
    [
        ("budget debate", [(ONE("budget", "debate"), [])]),
        ('"the budget"', [([PHRASE("the", "budget")], [])]),
        ('"the budget" of -runs', [([PHRASE("the", "budget"), [("of", 0)]], ONE("runs"))]),
        ('runs or "budget debate" -"the of"', [(ONE("runs"), []), ([PHRASE("budget", "debate")], [PHRASE("the", "of")])]),
        ("über tax-paying", [(ONE("über", "tax", "paying"), [])]),
        ("budget budget", [(ONE("budget", "budget"), [])]),
        ("absent debate", [(ONE("absent", "debate"), [])]),
        ('-runs ""', []),
        ("", []),
    ],
)
def test_search(simple, query, alternatives):
    want = {}
    for doc, text in corpus():
        found = [r for a in alternatives if (r := rank(tokens(text)[:60], *a)) is not None] if doc < 63 else []
        if found:
            want[doc] = sum(found)
    got = {r.id: r["rank"] for r in simple.search(query).where("id < 63").collect()}
    assert got == pytest.approx(want)


def test_order_and_limit(simple):
    rows = simple.search("the", most=5).collect()
    assert len(rows) == 5 and [(-r["rank"], r.id) for r in rows] == sorted((-r["rank"], r.id) for r in rows)
    assert simple.search("budget debate").where("id = 63").first()["rank"] == pytest.approx(0.1)


def test_reads_its_terms_only(simple):
    plan = simple.search("budget")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)


def test_stemmed_index(spark, tmp_path):
    docs = [(1, "The runner was running to the budgets"), (2, "He runs the budget"), (3, "A budget of the running"), (4, "nothing")]
    index = textindex.build(spark.createDataFrame(docs, "id long, body string"), "id", "body", str(tmp_path / "i"))
    ids = lambda q, **o: [r.id for r in index.search(q, **o).collect()]
    assert sorted(ids("run")) == [1, 2, 3] and sorted(ids("budgeting")) == [1, 2, 3]
    # stop words keep their places: two words lie between
    assert ids('"run to the budget"') == [1] and ids('"run the budget"') == [2] and ids('"run budget"') == []
    assert ids("the was") == [] and sorted(ids("the -runner budget")) == [2, 3]
    assert sorted(ids('"run" or -x', plain=True)) == []
    again = textindex.TextIndex(spark, index.folder)
    assert again.stemmed and sorted(r.id for r in again.search("RUNS").collect()) == [1, 2, 3]
    lengths = {r.doc: r.words for r in spark.read.parquet(f"{index.folder}/lengths").collect()}
    assert lengths == {1: 7, 2: 4, 3: 5, 4: 1}
    empty = textindex.build(spark.createDataFrame([], "id long, body string"), "id", "body", str(tmp_path / "e"))
    assert empty.search("budget").collect() == []


def test_stemmed_query(spark):
    """The registered query against stretches found in the texts themselves."""
    import pandas as pd

    from tessera.queries import fulltext

    folder = "/root/testdata/sf0.001"
    texts = pd.read_parquet(f"{folder}/documents.parquet").set_index("doc_id")["text"]
    split = {d: re.findall(r"[^\W_]+", (t or "").lower()) for d, t in texts.items()}
    distinct = spark.createDataFrame([(w,) for w in sorted({w for ws in split.values() for w in ws})], "word string")
    stems = {r.word: r.stem for r in distinct.withColumn("stem", stemming.stem(F.col("word"))).collect()}
    want = {}
    for doc, ws in split.items():
        terms = [stems[w] for w in ws]
        score = 0.0
        for units in (["thing", "end"], ["rest"]):
            last, before = {}, None
            for q, t in enumerate(terms):
                if t in units:
                    last[t] = q
                    if len(last) == len(units) and (before is None or min(last.values()) > before):
                        before = min(last.values())
                        score += 0.1 / (1 + q - before + 1 - len(units))
        if score:
            want[doc] = round(score, 6)
    got = {r.doc_id: r["rank"] for r in fulltext.stemmed_search(spark, folder).collect()}
    assert len(want) > 10 and got == pytest.approx(want, abs=2e-6)


def test_words_are_stemmed_once(spark, tmp_path, monkeypatch):
    """Stems are worked out for each different word, not for each document."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(word):
        asked.add(1)
        return word[:3]

    monkeypatch.setattr(textindex, "term_of", lambda word, stemmed: counted(word))
    docs = spark.createDataFrame([(i, "budget budgets debate the runner") for i in range(40)], "id long, body string")
    for limit in (textindex.BROADCAST_WORDS, 0):
        monkeypatch.setattr(textindex, "BROADCAST_WORDS", limit)
        asked.value = 0
        index = textindex.build(docs, "id", "body", str(tmp_path / f"i{limit}"))
        assert asked.value == 4
        rows = {(r.term, tuple(r.positions), r.doc) for r in index.postings(["bud", "deb", "run", "the"]).collect()}
        assert rows == {(t, p, i) for i in range(40) for t, p in (("bud", (1, 2)), ("deb", (3,)), ("run", (5,)))}


def test_index_shuffles_postings_once(spark):
    """A document's words are put together within its row; texts without words have none."""
    docs = spark.createDataFrame([(1, "b a, B c a"), (2, None), (3, " -"), (4, "a")], "id long, body string")
    placed = textindex._placed(docs, "id", "body")
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc, r.word, tuple(r.places)) for r in placed.collect()} == {(1, "a", (2, 5)), (1, "b", (1, 3)), (1, "c", (4,)), (4, "a", (1,))}


def test_texts_are_dealt_not_postings(spark, tmp_path, monkeypatch):
    """A task sorts the postings of its part of the documents; parts grow in number, not in size, and no result depends on them."""
    docs = spark.createDataFrame(corpus(2, 80), "id long, body string")
    seen, placed = [], textindex._placed
    monkeypatch.setattr(textindex, "_placed", lambda docs, key, text: seen.append(docs) or placed(docs, key, text))
    small = textindex.build(docs, "id", "body", str(tmp_path / "small"), stemmed=False, buckets=3)
    monkeypatch.setattr(textindex, "PART_WORDS", 100)
    large = textindex.build(docs, "id", "body", str(tmp_path / "large"), stemmed=False, buckets=3)
    assert [d.rdd.getNumPartitions() for d in seen] == [1, -(-sum(len(tokens(t)) for _, t in corpus(2, 80)) // 100)]
    rows = [{(r.doc, r.term, tuple(r.positions)) for r in i.postings(["the", "budget", "über"]).collect()} for i in (small, large)]
    assert rows[0] == rows[1] != set()
    files = large._rows.select("doc", F.input_file_name().alias("file"))
    assert files.groupBy("doc").agg(F.count_distinct(F.regexp_extract("file", "part-([0-9]+)", 1)).alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("most", [0, 4, 1000])
def test_stemmed_texts_are_dealt_not_postings(spark, tmp_path, monkeypatch, most):
    """Also with stems postings are made where they are sorted; only those of words too rare to be broadcast are shuffled, and no result depends on it."""
    docs = spark.createDataFrame(corpus(3, 80), "id long, body string")
    seen, placed = [], textindex._placed
    monkeypatch.setattr(textindex, "_placed", lambda docs, key, text: seen.append(docs) or placed(docs, key, text))
    monkeypatch.setattr(textindex, "PART_WORDS", 100)
    monkeypatch.setattr(textindex, "BROADCAST_WORDS", most)
    index = textindex.build(docs, "id", "body", str(tmp_path / "i"), buckets=3)
    assert [d.rdd.getNumPartitions() for d in seen] == [-(-sum(len(tokens(t)) for _, t in corpus(3, 80)) // 100)]
    split = {d: tokens(t) for d, t in corpus(3, 80)}
    distinct = spark.createDataFrame([(w,) for w in sorted({w for ws in split.values() for w in ws})], "word string")
    stems = {r.word: r.term for r in distinct.withColumn("term", textindex.term_of(F.col("word"), True)).collect() if r.term}
    want = {(d, t, tuple(p for p, w in enumerate(ws, 1) if stems.get(w) == t)) for d, ws in split.items() for t in {stems[w] for w in ws if w in stems}}
    got = [(r.doc, r.term, tuple(r.positions)) for r in index.postings(sorted(set(stems.values()))).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sorted(p.name for p in (tmp_path / "i" / "postings").glob("bucket=*")) == [f"bucket={b}" for b in sorted({r.bucket for r in index._rows.select("bucket").distinct().collect()} - {textindex.RARE})]
