"""Text and identifier expressions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vocabulary as v

MONTHS = "january february march april may june july august september october november december".split()


def normalize_label(c: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank."""
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


@cache
def _decompositions() -> tuple[str, str, str, list[str]]:
    """What code points below U+30000 become by compatibility decomposition (NFKD) without combining marks: (characters, their single ones, those that become more, what these become).

    Hangul syllables are left out, as they follow a rule.  Marks that vanish are
    the last of the characters, without a single one.
    """
    one, single, gone, many, longer = [], [], [], [], []
    for p in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000)):
        c = chr(p)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if bare == "":
            gone.append(c)
        elif len(bare) > 1:
            many.append(c), longer.append(bare)
        elif bare != c:
            one.append(c), single.append(bare)
    return "".join(one + gone), "".join(single), "".join(many), longer


def unaccented(c: Column) -> Column:
    """The compatibility decomposition (NFKD) without combining marks, of all characters."""
    plain, single, many, longer = _decompositions()
    # as lists of strings are literals too, a character's place in one finds it in the other
    table = F.split(F.lit("\u0001".join(longer)), "\u0001")
    jamo = lambda first, count: F.lit("".join(map(chr, range(first, first + count))))
    heads, middles, tails = jamo(0x1100, 19), jamo(0x1161, 21), jamo(0x11A8, 27)

    def wide(x: Column) -> Column:
        at = F.ascii(x) - 0xAC00
        tail = F.when(at % 28 > 0, F.substring(tails, at % 28, F.lit(1))).otherwise("")
        syllable = F.concat(F.substring(heads, F.floor(at / 588).cast("int") + 1, F.lit(1)), F.substring(middles, F.floor(at % 588 / 28).cast("int") + 1, F.lit(1)), tail)
        return F.when(at.between(0, 11171), syllable).otherwise(F.coalesce(F.get(table, F.call_function("instr", F.lit(many), x) - 1), x))

    # few texts have any of these at all
    rare = "[" + "".join(many) + "\uac00-\ud7a3]"
    spelt = F.when(c.rlike(rare), F.array_join(F.transform(F.split(c, ""), wide), "")).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(spelt, plain, single)).otherwise(c)


def fold(c: Column) -> Column:
    """normalize_label without accents and compatibility forms, for matching; white space of any script counts."""
    return F.trim(F.regexp_replace(F.lower(unaccented(c)), r"[\s\x1c-\x1f\x85\u1680\u2028\u2029]+", " "))


def strip_honorifics(c: Column) -> Column:
    """A person's name without leading titles and trailing honours."""
    bare = F.regexp_replace(F.trim(c), r"(?i)^(?:(?:the )?(?:most |right )?hon(?:ourable|\.)?|mr\.?|mrs\.?|ms\.?|miss|dr\.?|sir|dame|senator|minister)\s+", "")
    bare = F.regexp_replace(bare, r"(?i)^(?:mr\.?|mrs\.?|ms\.?|miss|dr\.?|sir|dame|senator|minister)\s+", "")
    return F.trim(F.regexp_replace(bare, r"(?i),?\s+(?:m\.?p\.?|q\.?c\.?|k\.?c\.?|s\.?c\.?|j\.?p\.?|esq\.?|jr\.?|sr\.?)$", ""))


#: Titles before and honours after a name in the graph, each taken off once, in this order.
NODE_HONORIFICS = [r"the\s+(?:most\s+)?honourable", r"hon\.?", r"mr\.?", r"ms\.?", r"mrs\.?", r"dr\.?", "senator"]
NODE_SUFFIXES = [r"M\.P\.", "MP", r"Jr\.?", r"Sr\.?", r"Esq\.?"]


def bare_name(c: Column) -> Column:
    """A person node's label without titles and honours."""
    out = F.trim(c)
    for title in NODE_HONORIFICS:
        out = F.trim(F.regexp_replace(out, rf"(?i)^{title}\s+", ""))
    for honour in NODE_SUFFIXES:
        out = F.trim(F.regexp_replace(out, rf"(?i)\s+{honour}$", ""))
    return out


def surname(c: Column) -> Column:
    """What stands before the first comma of a bare name, else its last word."""
    name = bare_name(c)
    return F.when(F.contains(name, F.lit(",")), F.trim(F.substring_index(name, ",", 1))).otherwise(F.regexp_extract(name, r"(\S*)$", 1))


def initials(c: Column) -> Column:
    """Capitals of a bare name's words that are initials: with a stop, of one capital letter, or of two of which the second is one."""
    words = F.filter(F.split(bare_name(c), r"\s+"), lambda w: w != "")
    of = lambda w: F.when(F.contains(w, F.lit(".")), F.upper(F.regexp_replace(w, r"\.", ""))).when(w.rlike(r"^\p{Lu}$"), w).when(w.rlike(r"^\p{L}\p{Lu}$"), F.upper(F.substring(w, 1, 1)))
    return F.array_join(F.array_compact(F.transform(words, of)), "")


def legislation_key(c: Column) -> Column:
    """A statute's title without years, folded."""
    return fold(F.regexp_replace(c, r"(?<![\p{L}\p{N}_])[0-9]{4}(?![\p{L}\p{N}_])", ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9\s_-]", ""), r"[\s-]+", "_"), r"_+", "_")


def hashed_id(prefix: str, *parts: Column) -> Column:
    """prefix and 12 hexadecimal digits of the parts joined by colons."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 12))


def entity_id(kind: Column, text: Column) -> Column:
    return hashed_id("ent_", kind, F.lower(F.trim(text)))


def node_id(kind: Column, label: Column) -> Column:
    return hashed_id("kg_", kind, normalize_label(label))


def edge_id(source: Column, predicate: Column, target: Column, *scope: Column) -> Column:
    return hashed_id("kge_", source, predicate, target, *scope)


def tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def words_in(text: str) -> list[str]:
    """What ``words_of`` finds in a text."""
    return [w.lower() for w in re.findall(r"\b[a-zA-Z][a-zA-Z0-9-]{2,}\b", text)]


def words_of(c: Column, pattern: str = r"[A-Za-z][A-Za-z0-9-]{2,}") -> Column:
    """Lower-case matches that stand as words, by default of three or more letters, digits and hyphens after a letter."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){pattern}(?:(?<!-)(?![\p{{L}}\p{{N}}_])|(?<=-)(?=[\p{{L}}\p{{N}}_]))"), F.lit(0)), lambda t: F.lower(t))


def query_terms(c: Column, stopwords: list[str]) -> Column:
    """Distinct words in first-seen order, without stop words."""
    stop = F.array(*map(F.lit, stopwords))
    return F.array_distinct(F.filter(words_of(c), lambda t: ~F.array_contains(stop, t)))


def query_intent(c: Column) -> Column:
    """struct<topic_terms, generic_terms, has_recency, is_topical> of a query; lists in first-seen order."""
    found = F.array_distinct(words_of(c))
    of = lambda names: F.filter(found, lambda t: t.isin(names))
    recent = F.lower(c).rlike("|".join(v.RECENCY_TERMS))
    return F.struct(of(v.TOPIC_TERMS).alias("topic_terms"), of(v.GENERIC_TERMS).alias("generic_terms"), F.coalesce(recent, F.lit(False)).alias("has_recency"), (F.size(of(v.TOPIC_TERMS)) > 0).alias("is_topical"))


def matched_terms(terms: Column, text: Column, most: int = 6) -> Column:
    """The first terms that occur in a text."""
    return F.slice(F.filter(terms, lambda t: F.contains(F.lower(text), t)), 1, most)


def lexical_rank(terms: Column, words: Column) -> Column:
    """Sum of the terms' frequencies over 1 + ln(number of words)."""
    counts = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.size(F.filter(words, lambda w: w == t)))
    return counts / (1 + F.ln(F.greatest(F.size(words), F.lit(1))))


def first_category(text: Column, categories: dict[str, list[str]], other: str = "other") -> Column:
    """The first category with a keyword in the text, in the order given."""
    low, out = F.lower(text), None
    for name, words in categories.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


def keywords(title: Column, others: Column, stopwords: list[str], most: int = 15) -> Column:
    """Distinct words of three or more characters: the title's, then those of an array of texts, in order."""
    stop = F.array(*map(F.lit, stopwords))
    useful = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: (F.char_length(t) >= 3) & ~F.array_contains(stop, t))
    return F.slice(F.array_distinct(F.concat(useful(F.coalesce(title, F.lit(""))), F.flatten(F.transform(others, useful)))), 1, most)


def to_seconds(c: Column) -> Column:
    """Seconds of HH:MM:SS or MM:SS; null for another shape or minutes and seconds beyond 59."""
    p = F.split(F.trim(c), ":")
    n = F.size(p)
    part = lambda i: F.get(p, i).try_cast("int")
    valid = F.trim(c).rlike(r"^\d{1,3}(:[0-5]?\d){1,2}$")
    three = part(F.lit(0)) * 3600 + part(F.lit(1)) * 60 + part(F.lit(2))
    return F.when(valid & (n == 3), three).when(valid & (n == 2), part(F.lit(0)) * 60 + part(F.lit(1)))


def to_timestamp_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    padded = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    return F.concat_ws(":", padded, two(F.floor(s % 3600 / 60)), two(s % 60))


def duration_seconds(c: Column) -> Column:
    """Seconds of H:MM:SS or MM:SS without bounds on minutes and seconds; null for another shape."""
    p = F.transform(F.split(F.trim(c), ":"), lambda x: x.try_cast("long"))
    two, three = F.get(p, F.lit(0)) * 60 + F.get(p, F.lit(1)), F.get(p, F.lit(0)) * 3600 + F.get(p, F.lit(1)) * 60 + F.get(p, F.lit(2))
    return F.when(F.size(p) == 3, three).when(F.size(p) == 2, two)


def timestamp_readings(raw: Column, duration: Column | None = None) -> Column:
    """array<struct<seconds, reason>>: how a timestamp, perhaps damaged, can be read; empty if it can't.

    Of three parts the plain reading comes first, if minutes and seconds are below
    60; then minutes and seconds whose third part is milliseconds (three digits, or
    over 59), whose first part can't be hours (24 and more), or whose second part
    can't be minutes.  Readings of three parts past the duration are left out.
    """
    p = F.split(F.trim(raw), ":")
    a, b, c = (F.get(p, F.lit(i)).try_cast("long") for i in range(3))
    made = lambda s, why: F.struct(s.alias("seconds"), F.lit(why).alias("reason"))
    millis = (F.length(F.get(p, F.lit(2))) > 2) | (c > 59)
    plain = F.when((b <= 59) & (c <= 59), made(a * 3600 + b * 60 + c, "hms"))
    other = F.when((b <= 59) & millis, made(a * 60 + b, "mmss_millis")).when((b <= 59) & (a >= 24), made(a * 60 + b, "mmss_hours")).when((b > 59) & (a == 0) & (c <= 59), made(b * 60 + c, "mmss_zero_hours"))
    three = F.array_compact(F.array(plain, other))
    if duration is not None:
        three = F.filter(three, lambda x: duration.isNull() | (x["seconds"] <= duration))
    none = F.array().cast("array<struct<seconds:bigint,reason:string>>")
    shaped = F.coalesce(F.trim(raw).rlike(r"^\d{1,9}(:\d{1,9}){1,2}$"), F.lit(False))
    return F.when(~shaped, none).when(F.size(p) == 2, F.array(made(a * 60 + b, "mmss"))).otherwise(three)


def first_reading(readings: Column) -> Column:
    """The reading of a sequence's first timestamp: milliseconds or hours that can't be before the plain one."""
    better = F.filter(readings, lambda x: x["reason"].isin("mmss_millis", "mmss_hours"))
    return F.get(F.concat(better, readings), F.lit(0))


def to_date_or_null(c: Column, form: str = "yyyyMMdd") -> Column:
    return F.try_to_date(F.nullif(F.trim(c), F.lit("")), form)


def prose_date(c: Column) -> Column:
    """The date in "Tuesday, the 3rd day of March, 2026" or "3 March 2026"."""
    months = F.array(*[F.lit(m) for m in "january february march april may june july august september october november december".split()])
    pattern = r"(?i)(\d{1,2})(?:st|nd|rd|th)?(?:\s+day)?(?:\s+of)?\s+(january|february|march|april|may|june|july|august|september|october|november|december),?\s+(\d{4})"
    day, month, year = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    return F.when(day != "", F.try_to_date(F.concat_ws("-", year, F.lpad(F.array_position(months, F.lower(month)).cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def title_date(c: Column) -> Column:
    """The date after a weekday in a title: "Tuesday 13th January, 2026"."""
    days = r"(?i)(?<![\p{L}\p{N}_])(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\s+(\d{1,2}(?:st|nd|rd|th)?\s+(?:january|february|march|april|may|june|july|august|september|october|november|december)[,]?\s+\d{4})(?!\d)"
    return prose_date(F.nullif(F.regexp_extract(c, days, 1), F.lit("")))


def slash_date(c: Column) -> Column:
    """DD/MM/YYYY as ISO text."""
    p = F.split(F.trim(c), "/")
    return F.when(F.size(p) == 3, F.concat_ws("-", F.get(p, 2), F.lpad(F.get(p, 1), 2, "0"), F.lpad(F.get(p, 0), 2, "0")))


def role_kind(label: Column) -> Column:
    """The kind of a role label, by the first rule that fits."""
    low = normalize_label(label)
    rules = [
        ("committee", r"committee|commission"),
        ("constituency", r"^member (?:for|of) "),
        ("executive", r"minister|^attorney general"),
        ("procedural", r"speaker|chair"),
        ("parliamentary", r"^leader of|senator|^member"),
    ]
    out = F.when(F.coalesce(low, F.lit("")) == "", F.lit("other"))
    for kind, pattern in rules:
        out = out.when(low.rlike(pattern), F.lit(kind))
    return out.otherwise(F.lit("other"))


def role_labels(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def timed_url(url: Column, seconds: Column) -> Column:
    """A video's URL at a time."""
    return F.when(seconds.isNull(), url).when(url.rlike(r"[?]"), F.concat(url, F.lit("&t="), seconds.cast("string"), F.lit("s"))).otherwise(F.concat(url, F.lit("?t="), seconds.cast("string"), F.lit("s")))


def url_seconds(url: Column) -> Column:
    """The time in a video's URL, of parameter t or else start (90, 90s or 1m30s; 0 for other words); null if there is none."""
    param = lambda name: F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    t = F.coalesce(param("t"), param("start"))
    part = lambda i: F.coalesce(F.regexp_extract(t, r"(?i)^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?", i).try_cast("long"), F.lit(0))
    return F.when(t.rlike(r"^\d+$"), t.try_cast("long")).when(t.isNotNull(), part(1) * 3600 + part(2) * 60 + part(3))


def source_seconds(seconds: Column, url: Column, stamp: Column) -> Column:
    """A source's time: its own seconds if above 0, else its URL's, else its timestamp's, else its own 0."""
    own = seconds.cast("long")
    return F.coalesce(F.when(own > 0, own), url_seconds(url), to_seconds(stamp).cast("long"), F.when(own == 0, own))


def absolute_url(url: Column, base: Column) -> Column:
    """A link of a site as a whole URL; ``base`` ends without a slash."""
    return F.when(F.startswith(url, F.lit("http")), url).when(F.startswith(url, F.lit("/")), F.concat(base, url)).otherwise(F.concat(base, F.lit("/"), url))


def is_bill_url(url: Column) -> Column:
    return F.contains(F.lower(url), F.lit("/bills/details/"))


def file_name(url: Column, other: str = "order_paper.pdf") -> Column:
    """The decoded last part of a URL's path; ``other`` if it has none."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), "/+$", ""), "/"), -1)
    decoded = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    return F.coalesce(F.nullif(decoded, F.lit("")), F.lit(other))


def temporary_id(c: Column) -> Column:
    return F.concat(F.lit("tmp_"), F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[^a-zA-Z0-9_]+", "_"))


def legislation_base(name: Column) -> Column:
    """The numbered part of a bill's id: its number, or else the first 10 characters of its name."""
    number = F.replace(F.regexp_extract(F.upper(name), r"((?:HR|SB|HB|S|H)\s*\d+)", 1), F.lit(" "), F.lit(""))
    return F.concat(F.lit("L_"), F.when(number != "", number).otherwise(F.replace(F.substring(F.upper(name), 1, 10), F.lit(" "), F.lit("_"))))


def page_url(url: Column, page: Column) -> Column:
    """A document's URL at a page; one that already has a page, or no page number above 0, leaves it as it is."""
    base = F.trim(url)
    return F.when((page > 0) & (base != "") & ~base.rlike(r"#page=\d+"), F.concat(base, F.lit("#page="), page.cast("string"))).otherwise(base)


def citation_parts(c: Column) -> Column:
    """struct<kind, bill, chunk> of ``bill:<bill>:<chunk>``; kind sentence for other ids."""
    p = F.split(c, ":")
    bill = (F.get(p, 0) == "bill") & (F.size(p) >= 3)
    return F.struct(
        F.when(bill, F.lit("bill")).otherwise(F.lit("sentence")).alias("kind"),
        F.when(bill, F.array_join(F.slice(p, F.lit(2), F.size(p) - 2), ":")).alias("bill"),
        F.when(bill, F.element_at(p, -1).try_cast("int")).alias("chunk"),
    )


def citation_id(c: Column) -> Column:
    """An id as it is cited, without a link's beginning, the source marker, and closing punctuation."""
    out = F.regexp_replace(F.trim(c), r"(?i)^https?://[^#]+#", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)^#?src:", ""), r"(?i)^source:", "")
    return F.trim(F.regexp_replace(out, r"[\]),.;]+$", ""))


def citation_keys(c: Column) -> Column:
    """What an id may be known as, best first: itself and its lower case, without or with the utterance prefix."""
    bare = F.when(F.startswith(c, F.lit("utt_")), F.substr(c, F.lit(5))).otherwise(F.concat(F.lit("utt_"), c))
    return F.array_distinct(F.filter(F.array(c, F.lower(c), bare, F.lower(bare)), lambda k: k != ""))


def cited_ids(answer: Column) -> Column:
    """Ids of #src: and source: links of an answer, in order and normalised."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(?i)(?:#src:|source:)([^,\s)\]]+)"), F.lit(1))
    return F.filter(F.transform(found, citation_id), lambda x: x != "")


def citations_in(answer: Column) -> Column:
    """Ids cited as [id] or as a link's #src: fragment, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(?:\(#src:|\[)([A-Za-z0-9_-]+(?::[A-Za-z0-9_-]+)+)[)\]]"), F.lit(1)))


def utterance_ids(ids: Column, video: Column) -> Column:
    """Ids with the video's prefix where they are bare seconds."""
    return F.transform(ids, lambda u: F.when(F.trim(u).rlike(r"^\d+$"), F.concat(video, F.lit(":"), F.trim(u))).otherwise(F.trim(u)))


def anchored_evidence(evidence: Column, content: Column) -> Column:
    """Evidence as it stands in a text: itself if it is there, else the text from the first run of 6, 5, 4 or 3 of its words that is, or from the beginning.

    The snippet is 40 characters longer than the evidence, 60 at least and 220 at most.
    """
    words = F.filter(F.split(F.regexp_replace(evidence, r"\s", " "), " "), lambda w: w != "")

    def anchors(n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.when(F.size(words) >= n, F.instr(content, F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.lit(0)))

    # from the first run that is found, of the longest length that has one
    at = F.coalesce(*[F.get(F.filter(anchors(n), lambda x: x > 0), F.lit(0)) for n in (6, 5, 4, 3)], F.lit(1))
    length = F.least(F.lit(220), F.greatest(F.lit(60), F.char_length(evidence) + 40))
    snippet = F.regexp_replace(F.substring(content, at, length), r"\s+$", "")
    return F.when((evidence != "") & F.contains(content, evidence), evidence).when(F.coalesce(content, F.lit("")) == "", evidence).otherwise(F.coalesce(F.nullif(snippet, F.lit("")), evidence))


def fenced_json(c: Column) -> Column:
    """The JSON object in a model's answer: without fences, from the first brace to the last."""
    bare = F.regexp_replace(c, r"```(?:json)?", "")
    return F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
