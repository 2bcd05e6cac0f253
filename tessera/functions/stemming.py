"""English stems by the Porter2 rules (Porter, 2001), as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that full-text search leaves out.
STOPWORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
don should now""".split()
#: Words with a stem of their own, words that stay, and words that stay after the plural is gone.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = "sky news howe atlas cosmos bias andes".split()
SINGULARS = "inning outing canning herring earring proceed exceed succeed".split()
#: Endings of the second, third and fourth step, with what they become.
SECOND = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = "[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT = "(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _ending(w: Column, endings) -> Column:
    """The longest of some endings that a word has, or an empty text."""
    return F.regexp_extract(w, f"(?:{'|'.join(endings)})$", 0)


def _cut(w: Column, ending: Column, other: Column | str = "") -> Column:
    return F.concat(F.substring(w, F.lit(1), F.char_length(w) - F.char_length(ending)), other if isinstance(other, Column) else F.lit(other))


def _lies_in(w: Column, ending: Column, region: Column) -> Column:
    return F.char_length(w) - F.char_length(ending) >= region


def _plural(w: Column) -> Column:
    w = let(w, lambda w: _cut(w, _ending(w, ["'s'", "'s", "'"])))
    plain = lambda w, e: F.when(e == "sses", _cut(w, F.lit("es"))).when(e.isin("ied", "ies"), _cut(w, e, F.when(F.char_length(w) > 4, "i").otherwise("ie"))).when((e == "s") & w.rlike("[aeiouy].+s$"), _cut(w, e)).otherwise(w)
    return let(w, lambda w: let(_ending(w, ["sses", "ied", "ies", "us", "ss", "s"]), lambda e: plain(w, e)))


def _participle(w: Column, r1: Column) -> Column:
    def mended(w):
        short = w.rlike(_SHORT) & (F.char_length(w) <= r1)
        return F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(w, F.lit("x"))).when(short, F.concat(w, F.lit("e"))).otherwise(w)

    def of(w, e):
        early = F.when(_lies_in(w, e, r1), _cut(w, e, "ee")).otherwise(w)
        late = let(_cut(w, e), lambda left: F.when(left.rlike("[aeiouy]"), let(left, mended)).otherwise(w))
        return F.when(e == "", w).when(e.isin("eed", "eedly"), early).otherwise(late)

    return let(w, lambda w: let(_ending(w, ["eedly", "ingly", "edly", "eed", "ing", "ed"]), lambda e: of(w, e)))


def _exchanged(w: Column, table: dict[str, str], region: Column, allowed: Callable[[Column, Column], Column]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return let(_ending(w, table), lambda e: F.when((e != "") & _lies_in(w, e, region) & allowed(w, e), _cut(w, e, F.try_element_at(pairs, e))).otherwise(w))


def _steps(w: Column, r1: Column, r2: Column) -> Column:
    w = let(_participle(w, r1), lambda w: F.when(w.rlike(".[^aeiouy][yY]$"), _cut(w, F.lit("y"), "i")).otherwise(w))
    second = lambda w, e: F.when(e == "li", w.rlike("[cdeghkmnrt]li$")).when(e == "ogi", w.rlike("logi$")).otherwise(F.lit(True))
    w = let(w, lambda w: _exchanged(w, SECOND, r1, second))
    w = let(w, lambda w: _exchanged(w, THIRD, r1, lambda w, e: (e != "ative") | _lies_in(w, e, r2)))
    w = let(w, lambda w: _exchanged(w, dict.fromkeys(FOURTH, ""), r2, lambda w, e: (e != "ion") | w.rlike("[st]ion$")))

    def last(w):
        silent = w.endswith("e") & (_lies_in(w, F.lit("e"), r2) | (_lies_in(w, F.lit("e"), r1) & ~_cut(w, F.lit("e")).rlike(_SHORT)))
        double = w.endswith("ll") & _lies_in(w, F.lit("l"), r2)
        return F.when(silent | double, _cut(w, F.lit("e"))).otherwise(w)

    return let(w, last)


def stem(word: Column) -> Column:
    """The stem of a lower-case English word."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y"), "([aeiouy])y", "$1Y")

    def of(w):
        begins = F.char_length(F.regexp_extract(w, f"^(?:gener|commun|arsen|{_REGION})", 0))
        r1 = F.when(begins > 0, begins).otherwise(F.char_length(w))
        goes_on = lambda r1: F.char_length(F.regexp_extract(F.substring(w, r1 + 1, F.char_length(w)), f"^{_REGION}", 0))
        r2 = lambda r1: let(goes_on(r1), lambda n: F.when(n > 0, r1 + n).otherwise(F.char_length(w)))
        whole = lambda r: let(_plural(w), lambda s: F.when(s.isin(SINGULARS), s).otherwise(_steps(s, r["r1"], r["r2"])))
        return let(r1, lambda r1: let(F.struct(r1.alias("r1"), r2(r1).alias("r2")), whole))

    known = F.create_map(*[F.lit(x) for pair in (IRREGULAR | {w: w for w in UNCHANGED}).items() for x in pair])
    return F.when(F.char_length(word) <= 2, word).otherwise(F.coalesce(F.try_element_at(known, word), F.lower(let(marked, of))))
