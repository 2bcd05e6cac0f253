"""Names of people as they are shown, and the keys by which they are found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as ft


def guessed_from_id(speaker_id: Column) -> Column:
    """A name from a speaker's id: "s_john_smith_1" is "john smith"."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(speaker_id, F.lit(""))), "^s_", ""), r"_\d+$", "")
    return F.trim(F.replace(bare, F.lit("_"), F.lit(" ")))


def without_title(name: Column) -> Column:
    """A normalised name without the honorific before it."""
    return F.trim(F.regexp_replace(F.trim(name), r"^(the\s+)?(most\s+)?(honourable|hon\.?|mr\.?|ms\.?|mrs\.?|dr\.?|senator)\s+", ""))


def _capital(word: Column, rest=lambda c: c) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), rest(F.substr(word, F.lit(2))))


def title_case(name: Column) -> Column:
    """Words with a capital, also after hyphens and apostrophes; dotted initials and short capitals stay capitals."""

    def word(w):
        parts = F.transform(F.split(w, r"(?<=[-'])|(?=[-'])"), lambda p: _capital(p, F.lower))
        return F.when(F.contains(w, F.lit(".")) & (F.char_length(w) <= 4), F.upper(w)).when((w == F.upper(w)) & (w != F.lower(w)) & (F.char_length(w) <= 3), w).otherwise(F.array_join(parts, ""))

    words = F.filter(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, word), " ")


def with_title(title: Column, name: Column) -> Column:
    """A name after its title written out; a title of another kind is only put in title case."""
    t, shown = F.lower(F.trim(F.coalesce(title, F.lit("")))), title_case(name)
    said = F.when(F.contains(t, F.lit("most")) & F.contains(t, F.lit("hon")), "The Most Honourable").when(F.contains(t, F.lit("hon")), "The Honourable")
    for start, form in (("mrs", "Mrs."), ("mr", "Mr."), ("ms", "Ms."), ("dr", "Dr.")):
        said = said.when(F.startswith(t, F.lit(start)), form)
    return F.when(t == "", shown).otherwise(F.trim(F.concat_ws(" ", said.otherwise(title_case(title)), shown)))


def shown(full: Column, normalized: Column, speaker_id: Column) -> Column:
    """A speaker's full name, else the normalised one (or what the id tells) with capitals and written-out titles, else the id."""
    full, raw = F.trim(F.coalesce(full, F.lit(""))), F.trim(F.coalesce(normalized, F.lit("")))
    raw = F.when(F.startswith(raw, F.lit("s_")), guessed_from_id(raw)).otherwise(raw)
    low = lambda w: F.lower(w)

    def word(w):
        said = F.when(low(w).isin("hon", "honourable", "hon."), "The Honourable").when(low(w).isin("mr", "mister"), "Mr.").when(low(w).isin("ms", "miss"), "Ms.")
        return said.when(low(w) == "mrs", "Mrs.").when(low(w) == "dr", "Dr.").otherwise(_capital(w))

    words = F.filter(F.split(raw, r"\s+"), lambda w: w != "")
    return F.when(full != "", full).when(raw == "", F.trim(F.coalesce(speaker_id, F.lit("")))).otherwise(F.array_join(F.transform(words, word), " "))


def reference(ref: Column, known: Column) -> Column:
    """A speaker reference as a node's id; null (drop the edge) if the speaker isn't among ``known`` ids, other references as they are."""
    r = F.trim(ref)
    bare = F.regexp_replace(r, "^speaker_", "")
    person = F.startswith(r, F.lit("speaker_")) | F.startswith(r, F.lit("s_"))
    return F.when(r == "", None).when(person, F.when(F.array_contains(known, bare), F.concat(F.lit("speaker_"), bare))).otherwise(r)


def keys(full: Column, normalized: Column, speaker_id: Column) -> Column:
    """The keys by which a speaker is looked up, best first."""
    each = F.transform(F.array(full, normalized, guessed_from_id(speaker_id)), lambda c: ft.normalize_label(F.coalesce(c, F.lit(""))))
    both = F.flatten(F.transform(each, lambda c: F.array(c, without_title(c))))
    return F.array_distinct(F.filter(both, lambda c: c != ""))
